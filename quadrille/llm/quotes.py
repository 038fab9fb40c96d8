"""Chat formatting: messages linked by what they quote, and conversations in reply order without the quotes.

A line's quote level is the number of > marks before it. Lines of one level up to a blank line or another level are a
passage, normalised (lower case, white space collapsed, so that re-wrapped quotes match) and hashed. Passages of
level 0 are a message's own; each hash is looked up at the first message of the conversation that has it as its own,
so a common passage has one place and no pairs arise. Sentences of passages are hashed and looked up in the same way, so a quote
of a part of a paragraph is linked too. A message replies to the original of its shallowest
linked quote, of several to the one with most characters in whole quoted passages, then in quoted sentences, then to the latest.
Root and depth of each reply come from ancestors that double their distance in each round.

Only DataFrame functions run here.

Defined results: a message that quotes nothing known is a root (so is one that quotes less than a sentence); the order is (root_turn, depth, turn) within conv_id,
in which each message stands after that to which it replies. A null text is empty; body has the level-0 lines without
attribution lines that introduce a quote, outer blank lines trimmed. A message is (conv_id, turn): rows repeating it are
kept and share its links. A null conv_id or turn links nothing. Other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

MARKS = r"^(?:[\x20\x09]?>)+[\x20\x09]?"
#: Where a sentence of a normalised passage ends.
SENTENCE = r"(?<=[.!?…])\x20"
#: "On ..., A wrote:" in the languages of the corpus.
ATTRIBUTION = r"^(?:On|Am|Le|El)\b.*\b(?:wrote|schrieb(?:\s.*)?|écrit|escribió)\s?:\s*$"


def _parsed(messages: DataFrame) -> DataFrame:
    """Adds __lines (level, rest), __passages (level, h, chars) and, for each of their sentences, __sentences of the same kind."""
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n")
    marks = lambda x: F.regexp_extract(x, MARKS, 0)
    level = lambda x: F.length(F.regexp_replace(marks(x), "[^>]", ""))
    tagged = F.transform(lines, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("rest")))
    df = messages.withColumn("__lines", tagged)
    at = lambda i: F.get("__lines", i)
    blank = lambda x: ~x["rest"].rlike(r"\S")
    begins = lambda x, i: ~blank(x) & ((i == 0) | F.coalesce(blank(at(i - 1)) | (at(i - 1)["level"] != x["level"]), F.lit(True)))
    df = df.withColumn("__ends", F.filter(F.transform("__lines", lambda x, i: F.when(blank(x) | begins(x, i), i)), lambda i: i.isNotNull()))
    df = df.withColumn("__begins", F.filter(F.transform("__lines", lambda x, i: F.when(begins(x, i), i)), lambda i: i.isNotNull()))
    # a passage runs to the next break behind its first line; both lists are sorted, so pair them by position
    spans = F.transform("__ends", lambda e, j: F.struct(e.alias("a"), F.coalesce(F.get("__ends", j + 1), F.size("__lines")).alias("b")))
    spans = F.filter(spans, lambda s: ~blank(at(s["a"])))
    text = lambda s: F.trim(F.lower(F.regexp_replace(F.array_join(F.transform(F.slice("__lines", s["a"] + 1, s["b"] - s["a"]), lambda x: x["rest"]), " "), r"\s+", " ")))
    passages = F.transform(spans, lambda s: F.struct(at(s["a"])["level"].alias("level"), text(s).alias("p")))
    df = df.withColumn("__plain", passages)
    hashed = lambda level, p: F.struct(level.alias("level"), F.xxhash64(p).alias("h"), F.length(p).alias("chars"))
    df = df.withColumn("__passages", F.transform("__plain", lambda x: hashed(x["level"], x["p"])))
    df = df.withColumn("__sentences", F.flatten(F.transform("__plain", lambda x: F.transform(F.split(x["p"], SENTENCE), lambda p: hashed(x["level"], p)))))
    return df.drop("__ends", "__begins", "__plain")


def _body() -> Column:
    """The level-0 lines without attributions, which stand before a quote in one line or in two."""
    at = lambda i: F.get("__lines", i)
    quoted = lambda i: F.coalesce(at(i)["level"], F.lit(0)) > 0
    own_level = lambda i: F.coalesce(at(i)["level"], F.lit(1)) == 0
    wraps = lambda a, b: F.coalesce(F.concat_ws(" ", F.rtrim(a["rest"]), F.ltrim(b["rest"])).rlike(ATTRIBUTION) & ~b["rest"].rlike(ATTRIBUTION), F.lit(False))
    before = lambda i: F.when(i > 0, at(i - 1))
    alone = lambda x, i: x["rest"].rlike(ATTRIBUTION) & quoted(i + 1)
    first = lambda x, i: own_level(i + 1) & quoted(i + 2) & wraps(x, at(i + 1))
    second = lambda x, i: quoted(i + 1) & F.coalesce(before(i)["level"] == 0, F.lit(False)) & wraps(before(i), x)
    own = F.filter("__lines", lambda x, i: (x["level"] == 0) & ~(alone(x, i) | first(x, i) | second(x, i)))
    return F.regexp_replace(F.array_join(F.transform(own, lambda x: x["rest"]), "\n"), r"^(?:[\x20\x09]*\n)+|(?:\n[\x20\x09]*)+$", "")


def replies(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, parent: the message that each replies to."""
    kinds = F.array(*(F.struct(F.lit(whole).alias("whole"), F.col(c).alias("xs")) for whole, c in ((True, "__passages"), (False, "__sentences"))))
    each = parsed.select("conv_id", "turn", F.explode(kinds).alias("k")).select("conv_id", "turn", "k.whole", F.explode("k.xs").alias("x")).select("conv_id", "turn", "whole", "x.*")
    quoted = each.where("level > 0")
    first = each.where("level = 0").groupBy("conv_id", "whole", "h").agg(F.min("turn").alias("parent"))
    linked = quoted.join(first, ["conv_id", "whole", "h"]).where("parent < turn")
    chars = lambda whole: F.coalesce(F.sum(F.when(F.col("whole") == whole, F.col("chars"))), F.lit(0))
    of_parent = linked.groupBy("conv_id", "turn", "level", "parent").agg(chars(True).alias("chars"), chars(False).alias("parts"))
    return of_parent.groupBy("conv_id", "turn").agg(F.max_by("parent", F.struct((-F.col("level")).alias("l"), "chars", "parts", "parent")).alias("parent"))


def _rooted(links: DataFrame) -> DataFrame:
    """conv_id, turn, parent, root, depth."""
    far = links.withColumn("root", F.col("parent")).withColumn("depth", F.lit(1).cast("long"))
    while True:
        far = written(far)
        above = far.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("up"), F.col("depth").alias("more"))
        if far.join(above, ["conv_id", "root"], "left_semi").isEmpty():
            return far
        far = far.join(above, ["conv_id", "root"], "left").select("conv_id", "turn", "parent", F.coalesce("up", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))


def linked_conversations(messages: DataFrame) -> DataFrame:
    """messages with body, n_quotes (quoted passages), parent_turn, root_turn, depth."""
    messages = messages.drop("body", "n_quotes", "parent_turn", "root_turn", "depth")
    parsed = _parsed(messages)
    links = _rooted(replies(parsed)).select(F.col("conv_id").alias("__c"), F.col("turn").alias("__t"), F.col("parent").alias("__parent"), F.col("root").alias("__root"), F.col("depth").alias("__depth"))
    df = parsed.join(links, (parsed["conv_id"] == links["__c"]) & (parsed["turn"] == links["__t"]), "left")
    return df.select(
        *(parsed[c] for c in messages.columns),
        _body().alias("body"),
        F.size(F.filter("__passages", lambda x: x["level"] > 0)).cast("long").alias("n_quotes"),
        F.col("__parent").alias("parent_turn"),
        F.coalesce("__root", parsed["turn"]).alias("root_turn"),
        F.coalesce("__depth", F.lit(0)).cast("long").alias("depth"),
    )
