"""Full-text matching as column expressions: tokens, phrases, substrings, English stems and a score."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD, GAP = r"[\p{L}\p{Nd}]+", r"[^\p{L}\p{Nd}]+"


def word_tokens(text: Column) -> Column:
    """Lower-cased words in order, with repeats. Cut before they are lowered, which may add marks; the bar ends a word for lower, too."""
    return F.array_remove(F.split(F.lower(F.regexp_replace(text, GAP, "|")), r"\|"), "")


def tokens(text: Column) -> Column:
    """Lower-cased words, each once, sorted."""
    return F.sort_array(F.array_distinct(word_tokens(text)))


def _verb_root(base: Column, word: Column) -> Column:
    """A base without its ending, if it has a vowel: a doubled last consonant but l, s, z is halved, and a last
    consonant-vowel-consonant, the last not w, x or y, gets an e."""
    root = (
        F.when(base.rlike(r"([^aeioulsz])\1$"), F.substr(base, F.lit(1), F.length(base) - 1))
        .when(base.rlike(r"[^aeiou][aeiou][^aeiouwxy]$"), F.concat(base, F.lit("e")))
        .otherwise(base)
    )
    return F.when(base.rlike("[aeiou]"), root).otherwise(word)


def english_stem(word: Column) -> Column:
    """Plural endings first, then one of ied, ing, ed, ly, er, est where the word is long enough."""
    cut = lambda w, k: F.substr(w, F.lit(1), F.length(w) - k)
    low = F.lower(word)
    n = F.length(low)
    single = (
        F.when((n > 4) & low.rlike("ies$"), F.concat(cut(low, 3), F.lit("y")))
        .when(low.rlike("sses$"), cut(low, 2))
        .when((n > 3) & low.rlike("[^sui]s$"), cut(low, 1))
        .otherwise(low)
    )
    m = F.length(single)
    ends = lambda s, k: (m > k) & F.endswith(single, F.lit(s))
    return (
        F.when(ends("ied", 4), F.concat(cut(single, 3), F.lit("y")))
        .when(ends("ing", 5), _verb_root(cut(single, 3), single))
        .when(ends("ed", 4), _verb_root(cut(single, 2), single))
        .when(ends("ly", 4), cut(single, 2))
        .when(ends("er", 4), _verb_root(cut(single, 2), single))
        .when(ends("est", 5), _verb_root(cut(single, 3), single))
        .otherwise(single)
    )


def stems(text: Column) -> Column:
    return stems_of(word_tokens(text))


def match(text: Column, needle: Column) -> Column:
    """All words of the needle occur."""
    return F.size(F.array_except(word_tokens(needle), word_tokens(text))) == 0


def phrase(text: Column, needle: Column) -> Column:
    """The words of the needle occur side by side, in order."""
    fenced = lambda c: F.concat(F.lit("|"), F.array_join(word_tokens(c), "|"), F.lit("|"))
    return F.contains(fenced(text), fenced(needle))


def substring(text: Column, needle: Column) -> Column:
    return F.contains(F.lower(text), F.lower(needle))


def stem(text: Column, needle: Column) -> Column:
    """All stems of the needle occur among the stems of the text."""
    return F.size(F.array_except(stems(needle), stems(text))) == 0


def stemming(root: str) -> list[str]:
    """All lower-cased words that english_stem may give this root for, and some more: what it cuts is put back."""
    ends = ("ing", "ed", "er", "est")
    singles = [root, root + "ly", *(root + e for e in ends), *(root + root[-1:] + e for e in ends)]
    singles += [root[:-1] + "ied"] if root.endswith("y") else []
    singles += [root[:-1] + e for e in ends] if root.endswith("e") else []
    plurals = [s + "s" for s in singles] + [s + "es" for s in singles if s.endswith("ss")] + [s[:-1] + "ies" for s in singles if s.endswith("y")]
    return sorted({*singles, *plurals})


def beginnings(words: list[str]) -> list[str]:
    """Some of these stand in every lower-cased text with one of the words: how the words begin, as far as it is ASCII, for other letters
    may be lowered otherwise beside other signs."""
    starts = sorted({re.match("[a-z0-9]*", w).group() for w in words})
    return [s for s in starts if not any(s != x and s.startswith(x) for x in starts)]


def words_of(text: Column) -> Column:
    """The words of a text in order, as they stand; one pass of a regular expression."""
    return F.regexp_extract_all(text, F.lit(f"{WORD}+"), F.lit(0))


def fenced(words: Column) -> Column:
    """Words of words_of as one lower-cased text, a bar before and behind each."""
    return F.concat(F.lit("|"), F.lower(F.array_join(words, "||")), F.lit("|"))


def times_in(bars: Column, word: str) -> Column:
    """How often a word occurs in a fenced text."""
    fence = f"|{word}|"
    return ((F.octet_length(bars) - F.octet_length(F.replace(bars, F.lit(fence), F.lit("")))) / len(fence.encode())).cast("int")


def any_in(bars: Column, words: list[str]) -> Column:
    """Whether one of the words occurs in a fenced text."""
    return bars.rlike(r"\|(?:" + "|".join(words) + r")\|")


def stems_of(words: Column) -> Column:
    return F.array_distinct(F.transform(F.array_distinct(words), english_stem))


def score(text: Column, needle: Column) -> Column:
    """At least 1 for a text that has the needle as a substring or all its stems, else 0.

    For each word of the needle 100 if it occurs, 60 if only its stem does, and 5 for each of up to three
    occurrences; 250 for the phrase, 80 for the substring, 400 for equality; less one for each further word, 40 at most.
    """
    have = word_tokens(text)
    return scored(F.lower(text), F.size(have), F.concat(F.lit("|"), F.array_join(have, "|"), F.lit("|")), have, stems(text), needle)


def scored(text: Column, size: Column, bars: Column, have: Column, roots: Column, needle: Column) -> Column:
    """The score of a lower-cased text by its number of words, and its words (fenced, and as a list) and stems."""
    low = F.lower(needle)
    wanted = word_tokens(low)
    times = lambda w: F.size(have) - F.size(F.array_remove(have, w))
    one = lambda w: F.when(F.array_contains(have, w), 100).when(F.array_contains(roots, english_stem(w)), 60).otherwise(0) + 5 * F.least(F.lit(3), times(w))
    hit = F.contains(text, low)
    phrase = (F.size(wanted) > 0) & F.contains(bars, F.concat(F.lit("|"), F.array_join(wanted, "|"), F.lit("|")))
    found = hit | ((F.size(wanted) > 0) & (F.size(F.array_except(stems(low), roots)) == 0))
    return F.when(found, total([F.aggregate(wanted, F.lit(0), lambda a, w: a + one(w))], phrase, hit, text == low, size, F.size(wanted))).otherwise(0).cast("bigint")


def total(points: list[Column], phrase: Column, hit: Column, same: Column, size: Column, wanted: Column) -> Column:
    """The score of a text that is found, by the points of the needle's words."""
    raw = sum(points, F.when(phrase, 250).otherwise(0) + F.when(hit, 80).otherwise(0) + F.when(same, 400).otherwise(0))
    spare = F.least(F.lit(40), F.greatest(F.lit(0), size - wanted))
    return F.greatest(F.lit(1), raw - spare).cast("bigint")
