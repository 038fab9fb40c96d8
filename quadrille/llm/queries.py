"""The registered queries of this subpackage, each over its whole table with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import containment, crf, divergence, jaccard, line_runs, maxplus, quotes, suffixes, token_files, warc
from .common import table


def op1_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: the patterns' spans and those of the random field."""
    model = crf.fitted(crf.labelled_table(spark))
    out = crf.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return out.drop("text")


def op2_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules: base counts and the verdict of the language histograms for every document."""
    out = divergence.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_maxplus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece encoding of all documents, the model's own ids, and whether decoding gives the text back."""
    out = maxplus.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model"), decoded=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix dedup: what each document loses to strings of 200 bytes that start anywhere else too."""
    out = suffixes.suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup: what each document loses as later copies of repeated line runs, and the rest's digest."""
    out = line_runs.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC: all pages archived, normalised to a member a record, and read back by the offset index."""
    return warc.archived(table(spark, sf_dir, "pages"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: the component of each document under links of 85 % over sets of 4-word shingles."""
    out = jaccard.classes(table(spark, sf_dir, "documents"), size=4, num=85)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as Arrow files of fixed-size sequences and read back."""
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op4_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotation linking: what each message replies to, its place in reply order, and its body without quotes."""
    out = quotes.linked_conversations(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "role", "n_quotes", "parent_turn", "root_turn", "depth", F.sha2(F.encode("body", "UTF-8"), 256).alias("body_sha256"))


def op5_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: each benchmark item that each document contains."""
    out = containment.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "n_shared", "n_item")


def queries() -> dict:
    return {"op1_crf": op1_crf, "op2_divergence": op2_divergence, "op3_token_files": op3_token_files, "op4_quotes": op4_quotes, "op5_containment": op5_containment, "op6_maxplus": op6_maxplus, "op7_suffixes": op7_suffixes, "op8_line_runs": op8_line_runs, "op9_warc": op9_warc, "op10_jaccard": op10_jaccard}


OP5_SQL = r"""
with w as (select 'd' as k, doc_id as id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
           union all select 'b', item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') from benchmark),
p as (select k, id, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5),
s as (select distinct k, id, array_to_string(ws[i:i + 4], ' ') as g from p),
m as (select id, count(*) as n from s where k = 'b' group by 1)
select d.id as doc_id, b.id as item_id, count(*)::bigint as n_shared, any_value(m.n)::bigint as n_item
from s d join s b on d.g = b.g and d.k = 'd' and b.k = 'b' join m on m.id = b.id
group by d.id, b.id having 100 * count(*) >= 80 * any_value(m.n)
"""

OP8_SQL = """
with cut as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
flat as (select doc_id, unnest(ls) as l, generate_subscripts(ls, 1) as line from cut),
seq as (select doc_id, l, line, row_number() over (partition by doc_id order by line) as pos
        from flat where regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
two as (select *, lead(l) over (partition by doc_id order by pos) as l2 from seq),
ranked as (select doc_id, pos, row_number() over (partition by l, l2 order by doc_id, pos) as k from two where l2 is not null),
gone as (select distinct doc_id, pos + d as pos from ranked, (values (0), (1)) v(d) where k > 1),
lost as (select doc_id, line from gone join seq using (doc_id, pos)),
runs as (select g.doc_id, count(*) as n_runs from gone g where not exists (select 1 from gone h where h.doc_id = g.doc_id and h.pos = g.pos - 1) group by 1),
rest as (select f.doc_id, string_agg(f.l, chr(10) order by f.line) as kept from flat f
         where not exists (select 1 from lost x where x.doc_id = f.doc_id and x.line = f.line) group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_lines, coalesce(x.n, 0)::bigint as n_removed, coalesce(r.n_runs, 0)::bigint as n_runs,
       sha256(coalesce(k.kept, '')) as kept_sha256
from documents d left join (select doc_id, count(*) as n from seq group by 1) n using (doc_id)
left join (select doc_id, count(*) as n from lost group by 1) x using (doc_id)
left join runs r using (doc_id) left join rest k using (doc_id)
"""

OP9_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first from p where n >= 100 group by d)
select page_id, n::bigint as payload_bytes, d as payload_digest,
       case when n >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
       case when n >= 100 and page_id <> first then first end as refers_to
from p left join f using (d)
"""

OP10_SQL = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
p as (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) as i from w where len(ws) > 0),
s as (select distinct doc_id, array_to_string(ws[i:i + 3], ' ') as g from p),
n as (select doc_id, count(*) as n from s group by 1),
l as (select a.doc_id as a, b.doc_id as b from s a join s b on a.g = b.g and a.doc_id <> b.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
      group by 1, 2 having 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))),
r as (select doc_id, doc_id as o from documents union select r.doc_id, l.b from r join l on l.a = r.o)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r.o) as component_id
from documents d join r using (doc_id) left join n using (doc_id) group by d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_containment": OP5_SQL, "op8_line_runs": OP8_SQL, "op9_warc": OP9_SQL, "op10_jaccard": OP10_SQL}
