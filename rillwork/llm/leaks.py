"""Test items that leaked into a corpus, wholly or in part.

Pigeonhole edit matching on words. A leak may be a part of an item only, so the error budget belongs
to a passage: each eight successive words of an item may have BUDGET word edits and are split
into BUDGET + 1 pieces of four words, one of which must stand in the text unchanged. A sorted index
of all items' pieces finds their exact hits at any offset; a passage around a hit is
verified with Myers' bit-parallel edit distance, which rejects chance hits and accepts edited copies.
Verified passages are then measured twice: as they are (exact runs), and with their edits.

Scale: documents stay where they are read, the items travel to them: no shuffle. Items beyond
`block` (or `most_chars` characters) can't travel; then pieces are hashed and joined, and only documents
that share a piece with an item meet it. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import mended, words

PASSAGE, RUN, SHARE = 8, 20, 0.5
#: Word edits a passage may have, and the words of each of its BUDGET + 1 pieces.
BUDGET = 1
PIECE = PASSAGE // (BUDGET + 1)
SCHEMA = "doc_id long, item_id long, distance int, longest_run int, covered_words int, near_run int, near_words int, item_words int, leaked boolean"
Items = tuple[tuple[int, tuple[str, ...]], ...]


def masks(pattern: list[str]) -> dict[str, int]:
    """Bit i of a word's mask is set where the pattern has the word at i."""
    out: dict[str, int] = {}
    for i, w in enumerate(pattern):
        out[w] = out.get(w, 0) | 1 << i
    return out


def myers_distance(peq: dict[str, int], m: int, text: list[str]) -> int:
    """Least edit distance of a pattern of m words to any stretch of the text (Myers 1999)."""
    full, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score = full, 0, m
    best = m
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = ((eq & pv) + pv ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph, mh = ph << 1 & full, mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return best


#: Hits that are looked at together, which bounds a worker's memory.
_AT_ONCE = 1_000_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class _Matcher:
    """Items as one array of word numbers with gaps between them, a sorted index of their pieces
    at all offsets, and the masks of their passages as they are asked for."""

    def __init__(self, items: Items):
        self.items = items
        self.vocabulary: dict[str, int] = {}
        gap = [-2] * (PASSAGE + BUDGET)
        flat, first = list(gap), []
        for _, w in items:
            first.append(len(flat))
            flat += [self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w] + gap
        self.flat = np.array(flat, np.int64)
        self.starts = np.array(first or [0])
        self.item_of = np.searchsorted(self.starts, np.arange(len(flat)), "right") - 1
        self.codes, self.at = self._codes(self.flat)
        order = np.argsort(self.codes, kind="stable")
        self.codes, self.at = self.codes[order], self.at[order]
        self.seen: dict[tuple[int, int], dict[str, int]] = {}

    @staticmethod
    def _codes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, positions) of the pieces made of known words only."""
        if len(ids) < PIECE:
            return np.array([], np.uint64), np.array([], np.int64)
        views = np.lib.stride_tricks.sliding_window_view(ids, PIECE)
        at = np.flatnonzero((views >= 0).all(axis=1))
        code = np.zeros(len(at), np.uint64)
        for j in range(PIECE):
            code = (code ^ (views[at, j].astype(np.uint64) + np.uint64(1))) * _MIX[j % len(_MIX)]
            code ^= code >> np.uint64(29)
        return code, at

    def hits(self, docs: list[list[str]]) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """Per text and item: exact hits (position in the text, offset in the item) of pieces, beside which another piece
        can stand with at most BUDGET edits: all but BUDGET of its words are there, shifted by no more than BUDGET."""
        edge = PASSAGE + BUDGET
        size = np.array([len(d) for d in docs])
        first = np.cumsum(size + edge) - size
        ids = np.full(int(first[-1] + size[-1]) + edge, -1, np.int64)
        known = self.vocabulary
        for d, begin in zip(docs, first.tolist(), strict=True):
            ids[begin : begin + len(d)] = [known.get(w, -1) for w in d]
        codes, places = self._codes(ids)
        low, high = np.searchsorted(self.codes, codes, "left"), np.searchsorted(self.codes, codes, "right")
        some = np.flatnonzero(high > low)
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        many = np.cumsum(high[some] - low[some])
        begin = 0
        while begin < len(some):
            done = many[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(many, done + _AT_ONCE, "right")))
            part = some[begin:end]
            count = high[part] - low[part]
            p = np.repeat(places[part], count)
            g = self.at[np.repeat(low[part] - np.cumsum(count) + count, count) + np.arange(count.sum())]
            same = np.all([ids[p + j] == self.flat[g + j] for j in range(PIECE)], axis=0)
            near = np.zeros((2, len(p)), np.int64)
            for side, offsets in enumerate((range(PIECE, PASSAGE), range(PIECE - PASSAGE, 0))):
                for j in offsets:
                    wanted = self.flat[g + j]
                    near[side] += np.any([ids[p + j + shift] == wanted for shift in range(-BUDGET, BUDGET + 1)], axis=0)
            keep = np.flatnonzero(same & (near.max(axis=0) >= PASSAGE - PIECE - BUDGET))
            p, g = p[keep], g[keep]
            d, k = np.searchsorted(first, p, "right") - 1, self.item_of[g]
            for key, x, y in zip(zip(d.tolist(), k.tolist(), strict=True), (p - first[d]).tolist(), (g - self.starts[k]).tolist(), strict=True):
                found.setdefault(key, []).append((x, y))
            begin = end
        return found

    def passage(self, k: int, start: int) -> dict[str, int]:
        made = self.seen.get((k, start))
        if made is None:
            made = self.seen[k, start] = masks(list(self.items[k][1][start : start + PASSAGE]))
        return made

    def verified(self, k: int, start: int, doc: list[str], p: int) -> bool:
        """Whether the passage stands at about position p of the text, with at most BUDGET edits."""
        return myers_distance(self.passage(k, start), PASSAGE, doc[max(0, p - BUDGET) : p + PASSAGE + BUDGET]) <= BUDGET


@lru_cache(maxsize=2)
def _matcher(items: Items) -> _Matcher:
    return _Matcher(items)


def _runs(doc: list[str], item: tuple[str, ...], hits: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Maximal equal runs (start in the item, length, shift to the text) through the hits (position in the text, offset in the item)."""
    seen: dict[int, int] = {}
    out = []
    for p, o in sorted(hits):
        if seen.get(p - o, -1) > p:
            continue
        a, b = p, p + PIECE
        i, j = o, o + PIECE
        while a and i and doc[a - 1] == item[i - 1]:
            a, i = a - 1, i - 1
        while b < len(doc) and j < len(item) and doc[b] == item[j]:
            b, j = b + 1, j + 1
        seen[p - o] = b
        out.append((i, j - i, a - i))
    return out


def _reach(offsets: set[int]) -> int:
    """How many words all passages that keep one of these pieces can cover."""
    total, last = 0, -PASSAGE
    for o in sorted(offsets):
        begin, end = max(o + PIECE - PASSAGE, last), o + PASSAGE
        total, last = total + end - begin, end
    return total


def _passages(matcher: _Matcher, k: int, doc: list[str], runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(shift, first word, end) of the item's stretches that verified passages make up."""
    m, found = len(matcher.items[k][1]), []
    for i, n, shift in runs:
        if n >= PASSAGE:
            found.append((shift, i, i + n))
        # passages that reach beyond the run and keep one piece of it
        starts = {o - d for o in range(i, i + n - PIECE + 1) for d in range(0, PASSAGE, PIECE)}
        found += [(shift, w, w + PASSAGE) for w in starts if 0 <= w <= m - PASSAGE and not i <= w <= i + n - PASSAGE and matcher.verified(k, w, doc, w + shift)]
    out: list[list[int]] = []
    for shift, a, b in sorted(found, key=lambda x: x[1]):
        for s in out:  # an edit may shift what follows by one word
            if abs(s[0] - shift) <= BUDGET and a <= s[2]:
                s[0], s[2] = shift, max(s[2], b)
                break
        else:
            out.append([shift, a, b])
    return [tuple(s) for s in out]


def examine_all(docs: list[list[str]], items: Items) -> list[tuple]:
    """(index of text, index of item, distance, longest run, covered words, longest near run, near words, item words,
    leaked) of the items of which a text holds enough, as they are or with edits."""
    matcher = _matcher(items)
    out = []
    for (d, k), places in matcher.hits(docs).items() if docs and items else ():
        doc, item = docs[d], items[k][1]
        m = len(item)
        if _reach({o for _, o in places}) < min(RUN, SHARE * m):
            continue
        runs = _runs(doc, item, places)
        near = _passages(matcher, k, doc, runs)
        if not near:
            continue
        exact, edited = np.zeros(m, bool), np.zeros(m, bool)
        longest = max((n for _, n, _ in runs if n >= PASSAGE), default=0)
        for i, n, _ in runs:
            if n >= PASSAGE:
                exact[i : i + n] = True
        for _, a, b in near:
            edited[a:b] = True
        covered, close, close_run = int(exact.sum()), int(edited.sum()), max(b - a for _, a, b in near)
        leaked = longest >= RUN or covered >= SHARE * m
        if leaked or close_run >= RUN or close >= SHARE * m:
            spans: list[list[int]] = []
            for p, o in sorted(places):
                a, b = max(0, p - o - PASSAGE), min(len(doc), p + m - o + PASSAGE)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            peq = masks(list(item))
            distance = min(myers_distance(peq, m, doc[a:b]) for a, b in spans)
            out.append((d, k, distance, longest, covered, close_run, close, m, leaked))
    return out


def examine(doc: list[str], items: Items) -> list[tuple]:
    """The same of one text."""
    return [r[1:] for r in examine_all([doc], items)]




_TYPES = (pa.int64(), pa.int64(), *(pa.int32(),) * 6, pa.bool_())
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)


def _scan(items: Items, at_once: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            ids, docs, n = [], [], 0
            for doc_id, text, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text:
                    ids.append(doc_id)
                    docs.append(words(mended(text, raw)))
                    n += len(docs[-1])
                if n > at_once:
                    rows += [(ids[d], items[k][0], *rest) for d, k, *rest in examine_all(docs, items)]
                    ids, docs, n = [], [], 0
            rows += [(ids[d], items[k][0], *rest) for d, k, *rest in examine_all(docs, items)]
            yield _batch(rows)

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, raw) to (key, hash of a piece), each once per text."""
    for batch in batches:
        keys, pieces = [], []
        for key, text, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            w = words(mended(text, raw))
            mine = {xxhash.xxh64_intdigest(" ".join(w[i : i + PIECE])) - 2**63 for i in range(len(w) - PIECE + 1)}
            keys += [key] * len(mine)
            pieces += mine
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(pieces, pa.int64())], names=["key", "piece"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (doc_id, text, raw, item_id, item_text), those of one document together."""
    of, doc = None, []
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text, raw, item, item_text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if text != of:
                of, doc = text, words(mended(text, raw))
            rows += [(doc_id, item, *rest) for _, *rest in examine(doc, ((item, tuple(words(item_text))),))]
        yield _batch(rows)


def _joined(table: DataFrame, items: DataFrame) -> DataFrame:
    """The same pairs by a join of piece hashes. Keys are hashes too: texts that share one are only compared in vain."""
    docs = table.where("text is not null").withColumn("key", F.xxhash64("doc_id", "text"))
    wanted = items.withColumn("item_key", F.xxhash64("item_id", "item_text"))
    nothing = F.lit(None).cast("binary")
    theirs = wanted.select("item_key", "item_text", nothing).mapInArrow(_pieces, "key long, piece long").withColumnRenamed("key", "item_key")
    mine = docs.select("key", "text", "raw").mapInArrow(_pieces, "key long, piece long")
    pairs = mine.join(theirs, "piece").select("key", "item_key").distinct()
    full = docs.join(pairs, "key").join(wanted, "item_key").select("key", "doc_id", "text", "raw", "item_id", "item_text")
    return full.sortWithinPartitions("key").select("doc_id", "text", "raw", "item_id", "item_text").mapInArrow(_verify, SCHEMA)


def find_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", raw_col: str | None = "raw_bytes", item_id: str = "item_id", item_text: str = "item_text", block: int = 5_000, most_chars: int = 10_000_000) -> DataFrame:
    """One row per document and item of which the document holds a good part. Columns as SCHEMA.

    `leaked`: at least 20 successive words of the item, or at least half of its words in passages of eight
    or more, stand in the text as they are (`longest_run`, `covered_words`). `near_run` and `near_words`
    tell the same of passages in which one word of eight may be edited; rows are given for these too.
    `distance` is the least word edit distance between the item and any stretch of the text.

    Defined cases: null or empty texts hold nothing; items of fewer than eight words can't leak by this
    rule; repeated item ids are examined as one item each, mirrored documents are cases of their own. If
    `raw_col` is given, texts with broken characters are decoded anew from it."""
    suspicious = F.col(text_col).rlike("[\\uFFFD\\u0080-\\u00BF]|[\\u00C0-\\u00F4][\\u0080-\\u00BF\\u0152-\\u0178\\u02C6-\\u203A\\u20AC\\u2122]|\\p{L}\\?\\p{L}")
    raw = F.when(suspicious, F.col(raw_col)) if raw_col else F.lit(None).cast("binary")
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), raw.alias("raw"))
    wanted = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("item_text")).where("item_id is not null and item_text is not null").distinct()
    size = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("item_text")), F.lit(0)).alias("chars")).first()
    if size.n > block or size.chars > most_chars:
        return _joined(table, wanted)
    chosen = [(r.item_id, tuple(words(r.item_text))) for r in wanted.collect()]
    return table.mapInArrow(_scan(tuple(dict.fromkeys((i, w) for i, w in chosen if len(w) >= PASSAGE))), SCHEMA)
