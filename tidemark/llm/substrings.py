"""Repeated byte strings across documents, removed but for their first copy, by suffix arrays.

A string of LENGTH bytes (a window) that also starts earlier goes, with all bytes that it covers. Windows with equal bytes are found in
suffix arrays that two-stage sorting builds: only suffixes smaller than their successors are sorted directly; scans
over the buckets of first bytes induce the places of the rest; adjacent common prefixes then show equal windows.

So that no task needs all suffixes, windows are dealt out by their minimizer: the least hash of the strings of GRAM bytes
in a window. Equal windows have equal minimizers. Neighbouring windows with the same minimizer at the same place make a
piece; two windows of a piece are never equal.

0. A text that equals one of a smaller id goes as a whole, if it has LENGTH bytes; only the first copy is looked at further.
1. Minimizers that occur once in all can't be of a repeated window; the others are found first, by their hashes.
2. Equal pieces of a batch of documents are told at once: all but the first go, and only that is sent on.
3. Pieces with the same minimizer meet in one task as a block of text, whose suffix array is built. If a
   minimizer has very many pieces, they are dealt out at random, and each part's first windows meet once more by their digests.

Defined results: a null text is empty; documents with a null id are compared with nothing and stay as they are; rows of the same id come
in order of their text, so the second of two equal rows goes if it is long enough; extra columns are not used; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import blocks, words

GRAM = 32
#: Pieces of a minimizer that are compared in one task at most, on average; the rest is dealt out.
MANY = 256
#: Bytes of text in which minimizers are sought at once.
PART = 1 << 20
#: A place in a row's text has the row's number among those of the same id above these bits.
ROW = 40

_SECOND = np.uint64(0xA24BAED4963EE407)


def minimizers(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, key) of the pieces of each text: runs of windows whose first least hash of GRAM bytes is at the same place."""
    count = len(data) - length + 1
    none = np.empty(0, np.int64)
    if count <= 0:
        return none, none, np.empty(0, np.uint64)
    gram = min(GRAM, length)
    w = words.eight(data)
    g = np.zeros(len(data) - gram + 1, np.uint64)
    for k in range(0, gram - 7, 8):
        g = words.mix(g + w[k : k + len(g)] * np.uint64(0x9E3779B97F4A7C15))
    if gram % 8:
        g = words.mix(g + w[max(0, gram - 8) : max(0, gram - 8) + len(g)]) if gram >= 8 else words.mix(w[: len(g)] >> np.uint64(8 * (8 - gram)))
    each, span, have = g, length - gram + 1, 1
    while have * 2 <= span:
        g = np.minimum(g[:-have], g[have:])
        have *= 2
    if have < span:
        g = np.minimum(g[: len(g) - (span - have)], g[span - have :])
    good = np.arange(length, count + length) <= np.repeat(at[1:], np.diff(at))[:count]
    new = good.copy()
    # the place is another one if the hash is, or if the first window begins with it and so loses it
    new[1:] &= (g[1:] != g[:-1]) | (each[: count - 1] == g[:-1]) | ~good[:-1]
    begin = np.flatnonzero(new)
    if not len(begin):
        return none, none, np.empty(0, np.uint64)
    total = np.append(0, np.cumsum(good))
    many = total[np.append(begin[1:], count)] - total[begin]
    return begin, begin + many - 1 + length, words.mix(g[begin] + np.uint64(1))


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; equal bytes share the answer of the last of their run."""
    if not len(text):
        return np.zeros(0, bool)
    change = np.append(text[1:] != text[:-1], True)
    last = np.flatnonzero(change)
    up = np.append(text[last[:-1]] < text[last[:-1] + 1], False)
    return np.repeat(up, np.diff(np.append(-1, last)))


def _sorted_directly(word: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The places `at` by the first `depth` bytes (rounded up to whole words) of their suffixes."""
    at = at[np.argsort(word[at], kind="stable")]
    padded = np.append(word, np.zeros(depth + 8, np.uint64))
    same = np.append(False, padded[at[1:]] == padded[at[:-1]])
    for k in range(8, depth, 8):
        tied = same | np.append(same[1:], False)
        some = np.flatnonzero(tied)
        if not len(some):
            break
        group = np.cumsum(~same[some])
        key = padded[at[some] + k]
        order = np.lexsort((key, group))
        at[some] = at[some][order]
        key = key[order]
        same[some[1:]] &= key[1:] == key[:-1]
    return at


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes in order of their first `depth` bytes at least, by two-stage sorting."""
    n = len(text)
    small = smaller_than_next(text)
    direct = _sorted_directly(words.eight(text), np.flatnonzero(small), depth)
    first = text[direct]
    cut = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n:
        waiting[text[n - 1]].append(np.array([n - 1]))  # its successor is the empty suffix, the least of all
    out = []
    for c in range(256):
        level = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        larger = [level]
        while len(level):  # suffixes that begin with a run of c are induced from within the bucket
            before = level[level > 0] - 1
            level = before[(text[before] == c) & ~small[before]]
            larger.append(level)
        bucket = np.concatenate([*larger, direct[cut[c] : cut[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]
        order = np.argsort(text[before], kind="stable")
        before = before[order]
        head = text[before]
        for a, b in zip(*(lambda e: (e[:-1], e[1:]))(np.append(np.flatnonzero(np.append(True, head[1:] != head[:-1])), len(head)) if len(head) else np.zeros(1, np.int64)), strict=True):
            waiting[head[a]].append(before[a:b])
    return np.concatenate(out)


def same_windows(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """For each of the places `at` but the first whether its `length` bytes equal those at the place before it."""
    word = np.append(words.eight(text), np.zeros(length + 8, np.uint64))
    some = np.arange(1, len(at))
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 and length >= 8 else [])]:
        some = some[word[at[some] + k] == word[at[some - 1] + k]]
    if length < 8:
        shift = np.uint64(8 * (8 - length))
        some = some[word[at[some]] >> shift == word[at[some - 1]] >> shift]
    out = np.zeros(len(at), bool)
    out[some] = True
    return out


def _joined(piece: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, begin, end) of the runs that windows at these places cover; sorted by piece, then place."""
    new = np.ones(len(place), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (place[1:] > place[:-1] + length)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(place))[: len(begin)] - 1
    return piece[begin], place[begin], place[end] + length


def _merged(i: np.ndarray, place: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the same document that touch or overlap made one; a later span never ends before an earlier one."""
    order = np.lexsort((end, place, i))
    i, place, end = i[order], place[order], end[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (place[1:] > end[:-1])
    begin = np.flatnonzero(new)
    return i[begin], place[begin], end[np.append(begin[1:], len(i))[: len(begin)] - 1]


_PIECE = "f1 long, f2 long, part int, kind int, batch int, i long, place long, size long, text binary"
_ARROW = pa.schema([("f1", pa.int64()), ("f2", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("batch", pa.int32()), ("i", pa.int64()), ("place", pa.int64()), ("size", pa.int64()), ("text", pa.binary())])
#: Rows are pieces to compare, pieces of a minimizer with many, single windows of such, and spans that go.
ONE, SHARE, WINDOW, GONE = range(4)


def _rows(f1, f2, part, kind, batch, i, place, size, text=None) -> pa.Table:
    n = len(i)
    fill = lambda x, t: pa.array(np.broadcast_to(np.asarray(x), n).astype(t))
    values = [fill(f1, np.int64), fill(f2, np.int64), fill(part, np.int32), fill(kind, np.int32), fill(batch, np.int32), fill(i, np.int64), fill(place, np.int64), fill(size, np.int64)]
    return pa.Table.from_arrays([*values, pa.array(text, pa.binary()) if text is not None else pa.nulls(n, pa.binary())], schema=_ARROW)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def _gone(batch, i, place, end) -> pa.Table:
    return _rows(_signed(words.mix(np.asarray(i).astype(np.uint64) + np.uint64(5))), 0, 0, GONE, batch, i, place, end - place)


def _prepared(docs: pa.Table, ones: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The documents of a batch by id, then text; their ids, numbers of rows of the same id and whether they are first copies."""
    docs = docs.set_column(docs.schema.get_field_index("text"), "text", pc.fill_null(docs.column("text"), "")).sort_by([("i", "ascending"), ("text", "ascending")])
    ids = docs.column("i").to_numpy()
    same = np.arange(len(ids)) - np.searchsorted(ids, ids)
    first = {(i, k) for i, k in zip(ones.column("i").to_pylist(), ones.column("key").to_pylist(), strict=True) if k}
    own = np.array([(i, hashlib.md5(t.as_buffer(), usedforsecurity=False).hexdigest()) in first for i, t in zip(ids.tolist(), docs.column("text"), strict=True)], bool)
    return docs, ids, same.astype(np.int64) << ROW, own


def _pieces(docs: pa.Table, ones: pa.Table, length: int):
    """(documents' numbers, bytes, begin, end, key, places) of all pieces of first copies, in parts."""
    docs, ids, row, own = _prepared(docs, ones)
    use = np.flatnonzero(own)
    ids, row = ids[use], row[use]
    for k, data, at in words.parts(docs.column("text").take(pa.array(use)), PART):
        begin, end, key = minimizers(data, at, length)
        of = np.searchsorted(at, begin, "right") - 1
        yield ids[k + of], data, begin, end, key, begin - at[of] + row[k + of]


def _sent(docs: pa.Table, asked: pa.Table, length: int) -> pa.Table:
    """Pieces of a batch whose minimizer is repeated, equal ones but the first as spans that go."""
    if not len(docs) or not len(asked):
        return _ARROW.empty_table()
    batch, answer = docs.column("batch")[0].as_py(), blocks.answers(asked)
    got = []
    for i, data, begin, end, key, place in _pieces(docs, asked, length):
        times = blocks.known(key, answer)
        some = np.flatnonzero(times > 1)
        a, b = begin[some], end[some]
        # a piece's bytes are kept for as long as it takes to see whether it is the first
        got.append((i[some], place[some], b - a, key[some], times[some], words.hashes(data, a, b), words.hashes(data, a, b, _SECOND), data, a))
    if not got:
        return _ARROW.empty_table()
    i, place, size, key, times, h1, h2 = (np.concatenate([x[k] for x in got]) for k in range(7))
    order = np.lexsort((h2, h1))  # stable: of equal pieces the first comes first
    again = np.zeros(len(i), bool)
    again[order[1:]] = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
    starts = np.cumsum([0] + [len(x[0]) for x in got])
    text = []
    for (_, _, s, *_, data, a), first in zip(got, starts, strict=False):
        keep = np.flatnonzero(~again[first : first + len(s)])
        text += [data[x : x + n].tobytes() for x, n in zip(a[keep], s[keep], strict=True)]
    k = ~again
    parts = -(-times[k] // MANY)
    part = (words.mix(i[k].astype(np.uint64) * np.uint64(31) + place[k].astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int32)
    sent = _rows(_signed(key[k]), 0, part, np.where(parts > 1, SHARE, ONE), batch, i[k], place[k], size[k], text)
    return pa.concat_tables([sent, _gone(batch, *_merged(i[again], place[again], place[again] + size[again]))])


def _compared(t: pa.Table, length: int) -> pa.Table:
    """The spans that go of a block of pieces; of shares also the windows that stay. Spans pass through."""
    kind = t.column("kind").to_numpy()
    passed = t.filter(pa.array(kind == GONE))
    t = t.filter(pa.array(kind != GONE))
    if not len(t):
        return passed
    i, place, size, batch, kind = (t.column(c).to_numpy() for c in ("i", "place", "size", "batch", "kind"))
    f1, part = t.column("f1").to_numpy(), t.column("part").to_numpy()
    text = np.frombuffer(b"\0".join(t.column("text").to_pylist()) + b"\0", np.uint8)
    start = np.cumsum(size + 1) - (size + 1)
    # equal pieces go but for the first; where just one is left there is nothing to compare, if it is no share
    h1, h2 = words.hashes(text, start, start + size), words.hashes(text, start, start + size, _SECOND)
    order = np.lexsort((place, i, h2, h1))
    again = np.zeros(len(t), bool)
    again[order[1:]] = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
    out = [passed]
    for k in np.unique(batch[again]):
        some = again & (batch == k)
        out.append(_gone(k, *_merged(i[some], place[some], place[some] + size[some])))
    group = np.cumsum(np.append(False, (f1[1:] != f1[:-1]) | (part[1:] != part[:-1])))
    use = np.flatnonzero(~again & ((np.bincount(group[~again], minlength=group[-1] + 1)[group] > 1) | (kind == SHARE)))
    if not len(use):
        return pa.concat_tables(out)
    text = np.concatenate([text[start[k] : start[k] + size[k] + 1] for k in use])
    i, place, size, batch, kind = (x[use] for x in (i, place, size, batch, kind))
    start = np.cumsum(size + 1) - (size + 1)
    piece = np.repeat(np.arange(len(use)), size + 1)
    inner = np.arange(len(text)) - start[piece]
    window = inner + length <= size[piece]
    array = suffix_array(text, length)
    array = array[window[array]]
    group = np.cumsum(~same_windows(text, array, length)) if len(array) else array
    of = piece[array]
    spot = place[of] + inner[array]
    order = np.lexsort((spot, i[of], group))
    later = np.zeros(len(array), bool)
    later[order[1:]] = group[order[1:]] == group[order[:-1]]
    gone = np.sort(array[later])
    p, a, b = _joined(piece[gone], place[piece[gone]] + inner[gone], length)
    out.append(_gone(batch[p], i[p], a, b))
    stay = ~later & (kind[of] == SHARE)
    if stay.any():
        at = array[stay]
        word = np.append(words.eight(text), np.zeros(length + 8, np.uint64))
        f1, f2 = np.zeros(len(at), np.uint64), np.full(len(at), 7, np.uint64)
        for k in [*range(0, length - 7, 8), max(0, length - 8)]:
            w = word[at + k] if length >= 8 else word[at] >> np.uint64(8 * (8 - length))
            f1, f2 = words.mix(f1 + w * words.KEY), words.mix(f2 + w * _SECOND)
        out.append(_rows(_signed(f1), _signed(f2), 0, WINDOW, batch[of[stay]], i[of[stay]], spot[stay], length))
    return pa.concat_tables(out)


def _settled(t: pa.Table, begins: np.ndarray, length: int) -> pa.Table:
    """Of equal windows all but the first as spans that go; rows come by digest, id and place. Spans pass through."""
    kind = t.column("kind").to_numpy()
    first = np.zeros(len(t), bool)
    first[begins] = True
    i, place, batch = (t.column(c).to_numpy() for c in ("i", "place", "batch"))
    later = np.flatnonzero((kind == WINDOW) & ~first)
    later = later[np.lexsort((place[later], i[later]))]
    piece = np.cumsum(np.append(0, i[later][1:] != i[later][:-1])) if len(later) else later
    p, a, b = _joined(piece, place[later], length)
    one = later[np.searchsorted(piece, p)] if len(later) else later
    return pa.concat_tables([t.filter(pa.array(kind == GONE)), _gone(batch[one], i[one], a, b)]).select(["batch", "i", "place", "size"])


def _left(docs: pa.Table, spans: pa.Table, length: int) -> pa.Table:
    """(id, bytes, spans, what is left) of the documents of a batch."""
    docs, ids, row, own = _prepared(docs, spans)
    spans = spans.filter(pc.is_null(spans.column("key")))
    order = np.lexsort((spans.column("place").to_numpy(), spans.column("i").to_numpy()))
    i, a = spans.column("i").to_numpy()[order], spans.column("place").to_numpy()[order]
    b = a + spans.column("size").to_numpy()[order]
    sizes, found, kept = [], [], []
    texts = docs.column("text").cast(pa.binary())
    lo, hi = np.searchsorted(i, ids), np.searchsorted(i, ids, "right")
    for k, value in enumerate(texts):
        x = value.as_py()
        sizes.append(len(x))
        mine = []
        if not own[k] and len(x) >= length:
            mine.append([0, len(x)])
        elif lo[k] < hi[k]:
            some = slice(lo[k], hi[k])
            for p, q in zip(a[some] - row[k], b[some] - row[k], strict=True):
                if not 0 <= p < 1 << ROW:
                    continue
                if mine and p <= mine[-1][1]:
                    mine[-1][1] = max(mine[-1][1], int(q))
                else:
                    mine.append([int(p), int(q)])
        found.append([{"begin": p, "end": q} for p, q in mine])
        edges = [0, *(e for s in mine for e in s), len(x)]
        kept.append(b"".join(x[p:q] for p, q in zip(edges[::2], edges[1::2], strict=True)) if mine else x)
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    return pa.table({"i": docs.column("i"), "n_bytes": pa.array(sizes, pa.int64()), "spans": pa.array(found, kind), "kept": pa.array(kept, pa.binary())})


def dedup(df: DataFrame, id: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """(id, n_bytes, spans, kept): the removed spans of each text's UTF-8 bytes, as (begin, end), and the bytes that are left."""
    docs, size = blocks.batched(df.where(F.col(id).isNotNull()), id, text)

    key = F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))
    ones = df.where(F.col(id).isNotNull()).groupBy(key.alias("key")).agg(F.min(F.col(id).cast("long")).alias("i"))
    ones = ones.select(blocks.batch_of("i", max(1, -(-size // blocks.BATCH))).alias("batch"), "i", "key")
    none = lambda **kw: [F.lit(None).cast(t).alias(n) for n, t in kw.items()]

    def asking(docs: pa.Table, ones: pa.Table) -> pa.Table:
        keys = [key for *_, key, _ in _pieces(docs, ones, length)] if len(docs) and len(ones) else []
        return blocks.ask(docs.column("batch")[0].as_py() if len(docs) else 0, np.concatenate([np.empty(0, np.uint64), *keys]))

    by = docs.groupBy("batch")
    replies = blocks.repeated(by.cogroup(ones.groupBy("batch")).applyInArrow(asking, blocks.ASKED))
    replies = replies.select("batch", *none(i="long", key="string"), "hash", "count").unionAll(ones.select("batch", "i", "key", *none(hash="long", count="int")))
    sent = by.cogroup(replies.groupBy("batch")).applyInArrow(lambda d, a: _sent(d, a, length), _PIECE)
    found = blocks.in_runs(sent, ["f1", "part"], lambda t, b: _compared(t, length), _PIECE)
    spans = blocks.in_runs(found, ["f1", "f2"], lambda t, b: _settled(t, b, length), "batch int, i long, place long, size long", order=["i", "place"])
    spans = spans.select("batch", "i", *none(key="string"), "place", "size").unionAll(ones.select("batch", "i", "key", F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("size")))
    done = by.cogroup(spans.groupBy("batch")).applyInArrow(lambda d, s: _left(d, s, length), "i long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    alone = df.where(F.col(id).isNull()).select(F.lit(None).cast("long").alias("i"), F.octet_length(raw).cast("long").alias("n_bytes"), F.array().cast(done.schema["spans"].dataType).alias("spans"), raw.alias("kept"))
    return done.unionAll(alone).withColumnRenamed("i", id)
