"""Text quality: statistics of whole documents, their place among the documents of the language, and the shape of the text.

Every document is measured in one pass over all of its lines. A line is prose, item, row of cells or junk; each kind
weighs what it has of characters, and the shape is prose where at least half of all is, else the heaviest other kind.

Percentiles and medians come from mergeable quantile sketches per (lang, statistic): counts of buckets of
logarithmic width (relative error ACCURACY). Sketches of parts add up to that of the whole, whatever the order, so
results do not change from run to run; a sketch has as many rows as there are orders of magnitude, not documents.

A document is looked at where it is flagged: one of its statistics lies in a tail of its language's distribution by robust z-score
(the share of prose in the lower one, TAILS), or the language's median share of prose is below MOSTLY. Of the flagged, those are found
that are not prose by their lines. Nothing is lost by that: a text that is not prose has a share of prose below one half. Where the median is
MOSTLY or more, over half of the shares are within 1 - MOSTLY of it, so the scale is at most 0.15 / 0.6745; where that deviation is zero, it is at
most 1.2533 times half of the median. Either way such a text lies over 0.6 scales below.

Defined cases: null and blank texts are junk with statistics of zero; lang is the tag's first part in lower case
where it is one of COMMON, else the language with most common words in the text, else ``und``; a robust z-score is
null where the median deviation is zero.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHAPES = ("prose", "list", "table", "junk")
STATISTICS = ("n_words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words")
ACCURACY = 0.005
COMMON = {
    "en": "a an the this that these those it its he she they we you i his her their our your them us and or but if because so than as of in on at by for from to with about into over under after before between until within is are was were be been being has have had do does did will would can could may might should must not no nor there here when where who which what why how all any both each few more most other some such only own same too very just again once also one every even whether however although nobody".split(),
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber wenn weil dass daß so als wie von vom in im an am auf aus bei beim bis für gegen mit nach ohne über unter um vor zu zum zur zwischen durch seit ist sind war waren sein wird werden wurde wurden hat haben hatte hatten kann können muss müssen soll sollen darf nicht kein keine noch nur auch schon sehr man sich er sie es wir ihr ich uns ihnen ihre ihren seine seinen dieser diese dieses jede jeder alle viele da dann doch dort hier was wer wo".split(),
    "fr": "le la les l un une des du de d et ou mais si parce que qu ce cet cette ces il elle ils elles on nous vous je j tu me m se s son sa ses leur leurs notre nos votre vos dans sur sous par pour avec sans vers chez entre avant après depuis à au aux en y ne n pas plus rien est sont était étaient été être a ont avait avaient avoir sera seront fait faut peut doit qui quoi dont où quand comme tout tous toute toutes même aussi très encore là deux".split(),
    "es": "el la los las un una unos unas lo y e o u pero si porque que de del en a al con por para sin sobre entre hasta desde hacia antes después es son era eran fue fueron ser está están estaba estaban estado ha han había habían haber hay será serán puede debe no ni ya más muy también solo sólo se su sus mi mis nuestro nuestra nuestros le les nos yo él ella ellos ellas este esta estos estas ese esa eso como cuando donde quien cada todo todos toda todas otro otra dos quizá".split(),
}
_COMMON = {k: frozenset(v) for k, v in COMMON.items()}
_ANY = frozenset().union(*_COMMON.values())

_WORD = re.compile(r"[^\W\d_]+")
_SYMBOL = re.compile(r"[^\w\s]|_")
_REFERENCE = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_ROW = re.compile(r"<tr\b|</table\b", re.I)
_ITEM = re.compile(r"<li\b[^<>]*>", re.I)
_BREAK = re.compile(r"</?(?:p|div|br|h[1-6]|ul|ol|li|dl|dt|dd|section|article|blockquote|pre|table|tbody|thead)\b[^<>]*>", re.I)
_CELL = re.compile(r"<(?:td|th|tr)\b", re.I)
_TAG = re.compile(r"</?[a-z][^<>]*>|<[!?][^<>]*>", re.I)
_BULLET = re.compile(r"(?:[-*+•◦▪‣–—·○●■□☐☑✓✔]|\[[ xX]?\]|\(?\d{1,4}[.):]|\(?[a-zA-Z][.)]|[^\W\d_]+ \d{1,4}[:.)])\s+\S")
_PAIR = re.compile(r"[^\W\d_][^:.!?]{0,40}:\s+\S")
_LINK = re.compile(r"(?:https?://|www\.)\S+|\S+@\S+\.\S+")
_FRAME = re.compile(r"[|+\-=:\s─│┌┐└┘├┤┬┴┼═║╔╗╚╝╠╣╦╩╬]+")
_WIDE = re.compile(r"\S(?:\t| {2,})\s*(?=\S)")
_GARBLED = re.compile(r"[ÃÂ][^\sA-Za-z.,;:!?]|â[€\x80-\x9f‚-™]|�|[\x00-\x08\x0e-\x1f]")
_CODE = re.compile(r"[{}].*[{}]|\w+=\w+.*\w+=\w+|\[(?:INFO|WARN|WARNING|ERR|ERROR|DEBUG|TRACE|FATAL)\]")
_CLUSTER = re.compile(r"[bcdfghjklmnpqrstvwxzßñç]{4}")
_NUMBER = re.compile(r"[\"']?[-+]?\d[\d.,:/-]*%?[\"']?")
_END = (".", "!", "?", "…", "。", ":", ";", ".\"", "!\"", "?\"", ".)", "”", "»", "“")
_STOP = (".", "!", "?", "…", "。", "\"", ")", "”", "»", "“")


def language(tag: str | None, words: list[str]) -> str:
    """The tag's language where it is known, else the one whose common words the text has most of."""
    known = re.split(r"[-_]", (tag or "").strip().lower())[0]
    return known if known in _COMMON else spoken(words) or "und"


def spoken(words: list[str]) -> str | None:
    """The language with most common words in the text."""
    hits = {k: sum(w in v for w in words) for k, v in _COMMON.items()}
    best = max(sorted(hits), key=hits.__getitem__)
    return best if hits[best] else None


def _delimiter(lines: list[str]) -> str | None:
    """The delimiter of which most lines have the same number, as rows of cells have."""
    for mark in ("\t", "|", ";", ","):
        numbers = Counter(x.count(mark) for x in lines if mark in x)
        if not numbers:
            continue
        n, rows = numbers.most_common(1)[0]
        loose = sum(x.count(mark + " ") for x in lines) if mark in ";," else 0
        if rows >= 3 and rows >= 0.5 * len(lines) and (n >= 2 or mark == "\t") and loose < 0.3 * n * rows:
            return mark
    return None


def _odd(token: str) -> bool:
    """A token for machines: letters mixed with digits, or too long for a word."""
    if len(token) > 30:
        return True
    return len(token) >= 6 and any(c.isdigit() for c in token) and sum(c.isalpha() for c in token) >= 2 and not token[0].isupper()


def _usual(words: list[str], enough: float) -> int:
    """How many of the words are common in one language; not exact where no language can have ``enough``."""
    known = [w for w in words if w in _ANY]
    return len(known) if len(known) < enough else max(len([w for w in known if w in c]) for c in _COMMON.values())


def _line(s: str, words: list[str], mark: str | None, garbled: bool) -> str:
    """The kind of one line, whatever its language; ``frame`` where it only draws the border of a table."""
    if garbled and len(_GARBLED.findall(s)) > 0.15 * max(1, len(words)):
        return "junk"
    if "<" in s and _CELL.search(s):
        return "table"
    if not words and _FRAME.fullmatch(s) and ("|" in s or "+" in s or any("─" <= c <= "╬" for c in s)) and len(s) > 2:
        return "frame"
    letters = sum(map(len, words))
    if not words and not any(c.isdigit() for c in s):
        return "junk"
    code = ("=" in s or "{" in s or "}" in s or "[" in s) and _CODE.search(s)
    said = len(words) >= 4 and _usual(words, 0.2 * len(words)) >= 0.2 * len(words)
    if said and not code and not (mark and mark in "\t|" and s.count(mark) >= 2):
        if letters >= 0.8 * len(s) or len(_SYMBOL.findall(s)) < 0.3 * len(s):
            return "prose"
    if code:
        return "junk"
    if mark and mark in s or s.count("|") >= 2 or "\t" in s:
        return "table"
    if len(_WIDE.findall(s)) >= 2:
        return "table"
    rest = (_LINK.sub("", s) if "www." in s or "://" in s or "@" in s else s).split()
    if rest and sum(len(t) for t in rest if _odd(t)) > 0.5 * sum(map(len, rest)):
        return "junk"
    if letters < 0.4 * len("".join(rest)) and not any(_NUMBER.fullmatch(t) for t in rest):
        return "junk"
    long = [w for w in words if len(w) >= 5]
    usual = _usual(words, 0)
    if len(long) >= 4 and usual < 0.05 * len(words) and sum(bool(_CLUSTER.search(w)) for w in long) > 0.4 * len(long):
        return "junk"
    if len(words) >= 5 and not _BULLET.match(s) and not _PAIR.match(s) and ";" not in s and s.endswith(_STOP[:5]) and (s[0].isupper() or usual >= 0.1 * len(words)):
        return "prose"
    return "list"


def _repeats(lines: list[str], words: list[str]) -> bool:
    """One line or a few words make up nearly all of the text, again and again."""
    if len(lines) >= 4 and len(set(lines)) <= 0.25 * len(lines):
        return True
    if len(words) >= 10 and len(set(words)) <= max(2, 0.02 * len(words)) and len(set(words)) <= 8:
        return True
    return any(len(w) >= 24 and any(w == (w[:n] * (len(w) // n + 1))[: len(w)] for n in range(1, 13)) for w in set(words))


def measure(text: str | None, tag: str | None = None) -> tuple[str, list[float], list[float], str]:
    """(lang, STATISTICS, share of each of SHAPES, shape) of one text."""
    text = text or ""
    if "&" in text:
        text = _REFERENCE.sub(lambda m: html.unescape(m[0]), text)
    if "<" in text:
        text = _BREAK.sub("\n", _ITEM.sub("\n- ", _ROW.sub(lambda m: "\n" + m[0], _COMMENT.sub("", text))))
    lines = [s for s in map(str.strip, re.split(r"[\n\r\x0b\x0c\x85  ]", text)) if s]
    both = [(x, _TAG.sub(" ", x).strip() if "<" in x else x) for x in lines]
    kept, shown = [x for x, s in both if s], [s for _, s in both if s]
    said = [_WORD.findall(s.lower()) for s in shown]
    words = [w for ws in said for w in ws]
    lang = language(tag, words)
    size = sum(len(s) - s.count(" ") for s in shown)
    mine = _COMMON.get(lang, frozenset())
    statistics = [
        float(len(words)),
        sum(map(len, words)) / len(words) if words else 0.0,
        len(_SYMBOL.findall("\n".join(shown))) / size if size else 0.0,
        sum(s.endswith(_END) for s in shown) / len(shown) if shown else 0.0,
        len([w for w in words if w in mine]) / len(words) if words else 0.0,
    ]
    if not words or _repeats(lines, words):
        return lang, statistics, [0.0, 0.0, 0.0, 1.0], "junk"
    mark, garbled = _delimiter(lines), bool(_GARBLED.search(text))
    weight = dict.fromkeys((*SHAPES, "frame"), 0)
    for raw, s, ws in zip(kept, shown, said):
        weight[_line(raw, ws, mark, garbled)] += len(s) - s.count(" ")
    if weight["table"]:
        weight["table"] += weight["frame"]
    else:
        weight["junk"] += weight["frame"]
    total = sum(weight[k] for k in SHAPES)
    shares = [weight[k] / total if total else float(k == "junk") for k in SHAPES]
    shape = "prose" if shares[0] >= 0.5 else max(SHAPES[1:], key=lambda k: shares[SHAPES.index(k)])
    return lang, statistics, shares, shape


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, STATISTICS..., share_*..., shape): one row per document, over its whole text."""
    names = ["doc_id", "lang", *STATISTICS, *(f"share_{s}" for s in SHAPES), "shape"]
    kinds = ["bigint", "string", *["double"] * (len(names) - 3), "string"]

    def walk(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
        for batch in batches:
            rows = []
            for doc, text, tag in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                lang, statistics, shares, shape = measure(text.as_py(), tag)
                rows.append((doc, lang, *statistics, *shares, shape))
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds)], names=names)

    return documents.select("doc_id", "text", "lang").mapInArrow(walk, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


# ---- sketches

_GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: Bucket of zero, below that of every value; values below SMALLEST count as zero.
ZERO, SMALLEST = -(1 << 30), 1e-9


def bucket(value: Column) -> Column:
    return F.when(value < SMALLEST, F.lit(ZERO)).otherwise(F.ceil(F.log(value) / F.lit(math.log(_GAMMA))).cast("int"))


def bucket_value(b: Column) -> Column:
    return F.when(b == ZERO, F.lit(0.0)).otherwise(F.pow(F.lit(_GAMMA), b) * F.lit(2 / (1 + _GAMMA)))


def sketch(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bucket, n): the sketch of ``value``, not below zero."""
    return values.groupBy(*keys, bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))


def merge(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The sketch of the values of both."""
    return a.unionByName(b).groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def ranks(sketched: DataFrame, keys: list[str]) -> DataFrame:
    """Adds below and total: the number of values in lower buckets, and in all."""
    by = W.partitionBy(*keys)
    upto = F.sum("n").over(by.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
    return sketched.select("*", (upto - F.col("n")).alias("below"), F.sum("n").over(by).alias("total"))


def quantile(sketched: DataFrame, keys: list[str], q: float, name: str) -> DataFrame:
    """(keys, name): the value of rank ceil(q * total), the first at least."""
    rank = F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("total")))
    hit = ranks(sketched, keys).filter((F.col("below") < rank) & (F.col("below") + F.col("n") >= rank))
    return hit.select(*keys, bucket_value(F.col("bucket")).alias(name))


#: Median share of prose from which on a language is taken as mostly prose.
MOSTLY = 0.85
#: Statistic: from how many scales below and above the median on a document is in a tail.
TAILS = {"share_prose": (0.6, math.inf), **{name: (3.5, 3.5) for name in STATISTICS}}


def _long(documents: DataFrame, statistics: Sequence[str]) -> DataFrame:
    each = F.array(*(F.struct(F.lit(s).alias("statistic"), F.col(s).alias("value")) for s in statistics))
    return documents.select("lang", F.explode(each).alias("s")).select("lang", "s.*")


def scales(documents: DataFrame, statistics: Sequence[str]) -> DataFrame:
    """(lang, statistic, median, scale) from sketches, one row per language and statistic.

    scale is the median absolute deviation over 0.6745, or where that is zero 1.2533 times the mean one; both estimate
    the same for normal values. It is zero where all values are in one bucket.
    """
    keys = ["lang", "statistic"]
    base = sketch(_long(documents, statistics), keys)
    middle = quantile(base, keys, 0.5, "median")
    apart = base.join(F.broadcast(middle), keys).select(*keys, "n", F.abs(bucket_value(F.col("bucket")) - F.col("median")).alias("value"))
    mean = apart.groupBy(*keys).agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))
    again = apart.groupBy(*keys, bucket(F.col("value")).alias("bucket")).agg(F.sum("n").alias("n"))
    mad = quantile(again, keys, 0.5, "mad")
    scale = F.when(F.col("mad") > 0, F.col("mad") / 0.6745).otherwise(F.col("mean") * 1.2533)
    return middle.join(mad, keys).join(mean, keys).select(*keys, "median", scale.alias("scale"))


def flagged(documents: DataFrame) -> DataFrame:
    """The measured documents with a statistic in a tail of their language, and in ``tails`` the names of these statistics.

    What is sent to all tasks is one row a language, of which there are at most one more than in COMMON.
    """
    per = scales(documents, list(TAILS))
    wide = per.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("statistic", F.struct("median", "scale")))).alias("_of"))
    placed = documents.join(F.broadcast(wide), "lang")
    marks = []
    for name, (low, high) in TAILS.items():
        of = F.col("_of")[name]
        z = (F.col(name) - of["median"]) / F.nullif(of["scale"], F.lit(0.0))
        out = (z <= F.lit(-low)) | (z >= F.lit(high))
        if name == "share_prose":
            out = out | (of["median"] < F.lit(MOSTLY))
        marks.append(F.when(out, F.lit(name)))
    return placed.withColumn("tails", F.array_compact(F.array(*marks))).drop("_of").filter(F.size("tails") > 0)


def scored(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, statistic, value, percentile, robust_z) of measured documents.

    percentile is the share of the language's documents below, half of the equal ones counted in; robust_z is
    0.6745 times the distance from the median in median absolute deviations.
    """
    keys = ["lang", "statistic"]
    long = documents.select("doc_id", "lang", F.explode(F.array(*(F.struct(F.lit(s).alias("statistic"), F.col(s).alias("value")) for s in STATISTICS))).alias("s")).select("doc_id", "lang", "s.*")
    base = sketch(long, keys)
    middle = quantile(base, keys, 0.5, "median")
    apart = long.join(F.broadcast(middle), keys).select(*keys, F.abs(F.col("value") - F.col("median")).alias("value"))
    spread = quantile(sketch(apart, keys), keys, 0.5, "mad")
    places = ranks(base, keys).select(*keys, "bucket", ((F.col("below") + F.col("n") / 2) / F.col("total")).alias("percentile"))
    placed = long.withColumn("bucket", bucket(F.col("value"))).join(places, [*keys, "bucket"]).join(F.broadcast(middle), keys).join(F.broadcast(spread), keys)
    z = F.when(F.col("mad") > 0, F.lit(0.6745) * (F.col("value") - F.col("median")) / F.col("mad"))
    return placed.select("doc_id", "lang", "statistic", "value", "percentile", z.alias("robust_z"))
