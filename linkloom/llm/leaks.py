"""Leaked evaluation texts: a generalised suffix automaton over the words of all items, walked by every document.

The items are few and known whole, the documents many: so the automaton is built once over the items and sent to every
task, and a document is one walk over its words. A state stands for all runs of words that end at the same places of
the items; the longest run that ends at a word is known in each step, and the items that hold its last
MIN_WORDS words are those of the state on its suffix path whose lengths span MIN_WORDS.

Before the walk, one window of ANCHOR words in every MIN_WORDS - ANCHOR + 1 is looked up among the items' windows. A
run of MIN_WORDS words covers one of these, so a document without a hit holds no case.

Words: markup and invisible characters are taken out and character references resolved; what white space separates is a
word, by its letters and digits in compatibility form without letter case. A word of none of these is no word.
Block-level tags (BLOCKS) separate words as a line break does, inline tags do not.

Defined cases: items of less than MIN_WORDS words leak nowhere; null and blank texts hold nothing; a passage repeated in
a document is one case; a run that crosses from one item to another is no case; no items give no cases.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame

MIN_WORDS = 13
ANCHOR = 3
BLOCKS = "address|article|aside|blockquote|br|caption|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
_HIDDEN_TEXT = re.compile(r"<!--.*?-->|<(script|style)\b[^<>]*>.*?</\1\s*>", re.I | re.S)
_BLOCK = re.compile(rf"</?(?:{BLOCKS})(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[a-z][^<>]*>|<[!?][^<>]*>", re.I)
_REFERENCE = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
#: Characters without a picture that are no format characters (Cf): joiners, variation selectors, fillers.
_FILLERS = "͏ᅟᅠ឴឵᠋-᠏ㅤ︀-️ﾠ\U000e0100-\U000e01ef"
_NOT_ASCII = re.compile(r"[^\x00-\x7f]")
_FILLER = re.compile(f"[{_FILLERS}]")
_REST = re.compile(r"[^\w\n]|_")
_CONTROLS = re.compile(r"[\x00-\x08\x0e-\x1b\x7f]")


def words(text: str | None) -> list[str]:
    """The words of a text as they are compared."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub("", _BLOCK.sub("\n", _HIDDEN_TEXT.sub("", text)))
    if "&" in text:
        text = _REFERENCE.sub(lambda m: html.unescape(m[0]), text)
    if text.isascii():
        return [w for w in _REST.sub("", "\n".join(text.lower().split())).split("\n") if w]
    invisible = {c for c in set(_NOT_ASCII.findall(text)) if unicodedata.category(c) == "Cf"}
    if invisible:
        text = text.translate({ord(c): None for c in invisible})
    # White space is settled before normalisation, which turns some accents into a blank and a mark.
    text = "\n".join(_FILLER.sub("", text).split())
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return [w for w in _REST.sub("", text).split("\n") if w]


class Automaton:
    """The generalised suffix automaton of several word sequences; ``held[v]`` are the items of a state."""

    def __init__(self, items: Iterable[tuple[int, list[str]]], least: int = MIN_WORDS) -> None:
        self.least, self.anchor = least, min(ANCHOR, least)
        self.ids: dict[str, int] = {}
        self.next, self.link, self.length = [{}], [-1], [0]
        self.windows: set[tuple[str, ...]] = set()
        kept = [(i, w) for i, w in items if len(w) >= least]
        for _, w in kept:
            self.windows.update(zip(*(w[k:] for k in range(self.anchor))))
            last = 0
            for word in w:
                last = self._extend(last, self.ids.setdefault(word, len(self.ids)))
        held: list[set[int]] = [set() for _ in self.next]
        for item, w in kept:
            v = 0
            for word in w:
                v = u = self.next[v][self.ids[word]]
                while u > 0 and item not in held[u]:
                    held[u].add(item)
                    u = self.link[u]
        # The state of the last ``least`` words of what a state stands for; -1 where all of it is shorter.
        top = [-1] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if self.length[v] >= least:
                up = self.link[v]
                top[v] = top[up] if self.length[up] >= least else v
        self.top = top
        self.held = {v: tuple(sorted(held[v])) for v in set(top) if v >= 0}

    def _add(self, length: int, follow: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.next.append(follow)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A state for the runs of q that end a run of p and c, where q has longer ones too."""
        clone = self._add(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._add(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def items_in(self, w: list[str]) -> set[int]:
        """The items of which ``w`` holds at least ``least`` consecutive words."""
        n, step = self.anchor, self.least - self.anchor + 1
        if len(w) < self.least or self.windows.isdisjoint(tuple(w[k : k + n]) for k in range(0, len(w) - n + 1, step)):
            return set()
        found: set[int] = set()
        ids, follow, link, length, top, held, least = self.ids, self.next, self.link, self.length, self.top, self.held, self.least
        v = run = 0
        for word in w:
            c = ids.get(word)
            if c is None:
                v = run = 0
                continue
            while v and c not in follow[v]:
                v = link[v]
                run = length[v]
            if c in follow[v]:
                v = follow[v][c]
                run += 1
            if run >= least:
                found.update(held[top[v]])
        return found


def find(items: DataFrame, documents: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(item_id, doc_id): each document with each item of which it holds ``least`` consecutive words. items: item_id, text."""
    spark = documents.sparkSession
    automaton = Automaton(((r["item_id"], words(r["text"])) for r in items.select("item_id", "text").distinct().toLocalIterator()), least)
    sent = spark.sparkContext.broadcast(automaton)

    def walk(batches: Iterator) -> Iterator:
        import pyarrow as pa

        a = sent.value
        for batch in batches:
            out: tuple[list[int], list[int]] = ([], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for item in sorted(a.items_in(words(text.as_py()))):
                    out[0].append(item)
                    out[1].append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["item_id", "doc_id"])

    return documents.select("doc_id", "text").mapInArrow(walk, "item_id bigint, doc_id bigint")
