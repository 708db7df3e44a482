"""Exact removal of repeated byte strings by suffix arrays.

Every string of LENGTH bytes that starts at two places or more is found, and
all bytes that such strings cover are removed.

1. Anchors. Among the GRAM-byte windows inside a LENGTH-byte string the one of
   least hash is its anchor, so equal strings have equal anchors at equal
   offsets. A run of consecutive strings with one anchor is that anchor's
   context: the bytes from the first string's start to the last one's end.
2. Contexts that occur twice whole are repeats at once. Anchors with at least
   two different contexts are contested: their contexts' strings may agree in
   part. No other string can be repeated.
3. Finer anchors. An anchor with more than SPREAD different contexts (a passage
   in very many texts, a large group of near copies) is split by a further
   function of the string: the longer window of least hash by another hash.
   Equal strings agree on that as well, so they still meet, and strings that
   don't share the longer window part. The shorter contexts that come out are
   handled as in 2, and split once more where they are still too many.
4. Shards. The contested contexts, one of each text, are dealt to shards by
   anchor, so strings that may be equal meet. A shard sorts its suffixes
   (Larsson and Sadakane's refinement: ranks double in depth, and only groups
   that still tie are sorted again), takes common prefixes of neighbours by
   Kasai's argument, and a common prefix of LENGTH or more is a repeat. Strings
   of two anchors differ, so a shard takes whole anchors of about PART bytes at
   a time: an array of suffixes needs some 70 bytes a byte while it is made.
5. An anchor that the longest windows leave with very many contexts, each of a
   few strings, is dealt to several shards. Their sorted strings are merged by
   binary search: each shard's strings, as 128-bit digests in sorted runs
   dealt by range of digest, are looked up in the runs of the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm.common import bitmap, in_bitmap, stored, trim, utf8_slices

#: Bytes of a string, bytes of an anchor, contested contexts of a shard, contexts of an anchor in one shard,
#: lengths of anchors that are tried, strings of a range of digests.
LENGTH, GRAM, SHARD, SPREAD, LEVELS, RANGE = 400, 128, 6_000, 2_000, 3, 50_000

#: Bytes whose hashes or suffixes are in memory at a time, if one text or one anchor isn't more.
PART = 1 << 20

_MIX = 0x9E3779B97F4A7C15
_KEY = "i long, h long"


def gram_hashes(data: np.ndarray, gram: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each ``gram``-byte window, from windows of doubling length."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(_MIX)
    step, base = 1, 0x100000001B3
    out, done = None, 0  # of the parts of ``gram`` that are powers of two, shortest first
    while True:
        if gram & step:
            n = len(data) - done - step + 1
            out = h[:n].copy() if out is None else h[:n] * np.uint64(pow(0x100000001B3, done, 1 << 64)) + out[step : step + n]
            done += step
        if done == gram:
            break
        h = h[:-step] * np.uint64(base) + h[step:]
        base = base * base % (1 << 64)
        step *= 2
    h = out ^ np.uint64(salt * _MIX % (1 << 64))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def window_minima(key: np.ndarray, width: int) -> np.ndarray:
    """The least key of each ``width`` consecutive ones."""
    m, step = key, 1
    while step * 2 <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    return np.minimum(m[: len(key) - width + 1], m[width - step :]) if width > step else m


def contexts(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The contexts of some texts laid end to end: (anchor's hash, place of the
    anchor, first string, last string), places in ``data``; texts shorter than
    ``length`` have none."""
    none = np.zeros(0, np.int64)
    n = len(data) - length + 1
    if n <= 0:
        return none.astype(np.uint64), none, none, none
    h = gram_hashes(data, gram, salt)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    least = (window_minima(key, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)[:n]
    ok = np.ones(n, bool)  # strings that stay in their text
    for e in ends[1:-1].tolist():
        ok[max(0, e - length + 1) : e] = False
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    stop = np.flatnonzero(np.append(new[1:] | ~ok[1:], True) & ok)
    at = least[first]
    return h[at], at, first, stop


_ROWS = f"{_KEY}, anchor long, c long, a long, b long, span long, times long"


def _runs(data: np.ndarray, ends: np.ndarray, length: int, gram: int, salt: int = 0) -> tuple[np.ndarray, ...]:
    """Contexts of some texts, as (text, anchor, c, a, b, span, times), places from
    the text's start. c is a hash of the context's bytes and the anchor's offset,
    which with the anchor's own makes 128 bits; runs of the same context are one
    row with their number in times."""
    anchor, at, a, b = contexts(data, ends, length, gram, salt)
    raw = data.tobytes()
    c = np.array([xxhash.xxh3_64_intdigest(raw[s:e], seed=o) for s, e, o in zip(a.tolist(), (b + length).tolist(), (at - a).tolist(), strict=True)], np.uint64).view(np.int64)
    doc = np.searchsorted(ends, a, "right") - 1
    same = np.zeros(len(a), bool)
    if len(a):
        same[1:] = (c[1:] == c[:-1]) & (doc[1:] == doc[:-1]) & (a[1:] == b[:-1] + 1)
    head = np.flatnonzero(~same)
    tail = np.append(head[1:], len(a))[: len(head)] - 1
    base = ends[doc[head]]
    return doc[head], anchor[head].view(np.int64), c[head], a[head] - base, b[tail] - base, b[head] - a[head], tail - head + 1


def anchors(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(i, h, anchor, c, a, b, span, times): the contexts of each keyed text (``i``, ``h``, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, data, ends in utf8_slices(batch.column(2), PART):
                doc, *found = _runs(data, ends, length, gram)
                keys = [batch.column(k)[x:y].take(pa.array(doc)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, found)], names=["i", "h", "anchor", "c", "a", "b", "span", "times"])
        trim()

    return docs.select("i", "h", "text").mapInArrow(run, _ROWS)


def longer(length: int, gram: int, level: int) -> int:
    """Bytes of an anchor at a level: each takes three quarters of what the one before leaves of a string."""
    for _ in range(level):
        gram = length - (length - gram) // 4
    return gram


def _todo(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, list[dict], np.ndarray, list[bytes]]]:
    """Of texts with lists ``todo`` of contexts: (batch, contexts, their rows, their
    bytes), a few MB at a time. Rows that repeat id and text follow each other,
    and one of them does for all."""
    last = None
    for batch in batches:
        place = batch.schema.names.index
        keys = list(zip(batch.column(place("i")).to_pylist(), batch.column(place("h")).to_pylist(), strict=True))
        for x, y, data, ends in utf8_slices(batch.column(place("text")), 2 * PART):
            raw = data.tobytes()
            what, rows, out, size = [], [], [], 0
            for row, e, todo in zip(range(x, y), ends.tolist(), batch.column(place("todo"))[x:y].to_pylist(), strict=False):
                if keys[row] == last:
                    continue
                last = keys[row]
                for w in todo:
                    what.append(w)
                    rows.append(row)
                    out.append(raw[e + w["a"] : e + w["a"] + w["span"] + length])
                    size += len(out[-1])
                    if size > PART:
                        yield batch, what, np.array(rows, np.int64), out
                        what, rows, out, size = [], [], [], 0
            if out:
                yield batch, what, np.array(rows, np.int64), out


def finer(texts: DataFrame, length: int, gram: int, salt: int) -> DataFrame:
    """Rows as of ``anchors``: the contexts by longer anchors inside the contexts
    ``todo`` (a, span, anchor, known) of some texts. A context that is known to be
    repeated counts once more, as its strings are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, what, rows, parts in _todo(batches, length):
            ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            doc, anchor, c, a, b, span, times = _runs(np.frombuffer(b"".join(parts), np.uint8), ends, length, gram, salt)
            first, old, known = (np.array([w[k] for w in what], np.int64)[doc] for k in ("a", "anchor", "known"))
            anchor = anchor ^ (old.view(np.uint64) * np.uint64(_MIX)).view(np.int64)
            keys = [batch.column(batch.schema.names.index(k)).take(pa.array(rows[doc])) for k in ("i", "h")]
            yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, (anchor, c, a + first, b + first, span, times + known))], names=["i", "h", "anchor", "c", "a", "b", "span", "times"])
        trim()

    return texts.mapInArrow(run, _ROWS)


#: Masks that keep the first 0 to 7 bytes of eight.
_FIRST = np.array([(1 << 64) - (1 << (64 - 8 * k)) if k else 0 for k in range(8)], np.uint64)


def _eight(data: np.ndarray, kind: str) -> np.ndarray:
    """The eight bytes from each place on as a number, zeros past the end: a view that takes no memory of its own."""
    padded = np.append(data, np.zeros(8, np.uint8))
    return np.ndarray(len(data), kind, padded, strides=(1,))


class SuffixArray:
    """Suffixes of some strings laid end to end, each string closed by an end of
    its own that no other string has."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        n = len(data)
        self.data, size = data, np.diff(ends)
        self.of = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.left = (ends[1:][self.of] - np.arange(n)).astype(np.int32)  # bytes of the string from here on
        # seven bytes, none beyond the string, then how many there were
        most = np.minimum(self.left, 7)
        key = _eight(data, ">u8").astype(np.uint64) & _FIRST[most] | most.astype(np.uint64)
        order = np.argsort(key).astype(np.int32)
        rank = np.empty(n, np.int32)
        active, first = self._name(order, key[order], np.zeros(n, np.int32), np.arange(n, dtype=np.int32), rank)
        del key, order, most
        depth, strings = 7, len(size)
        while len(active):
            # suffixes that tie in ``depth`` bytes are told apart by the rank of what follows; an end comes before all
            goes_on = self.left[active] > depth
            after = np.where(goes_on, rank[np.minimum(active + depth, n - 1)] + strings, self.of[active])
            order = np.argsort(first.astype(np.int64) * (n + strings) + after)
            active, first = active[order], first[order]
            active, first = self._name(active, after[order], first, None, rank)
            depth *= 2
        self.rank = rank
        self.suffix = np.empty(n, np.int32)
        self.suffix[rank] = np.arange(n, dtype=np.int32)

    @staticmethod
    def _name(items: np.ndarray, key: np.ndarray, first: np.ndarray, slot: np.ndarray | None, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Give the sorted items their groups' first places as ranks; the items
        that still tie, and those ranks."""
        n = len(items)
        if not n:
            return items, first
        group = np.append(True, first[1:] != first[:-1])
        new = group.copy()
        new[1:] |= key[1:] != key[:-1]
        at = np.arange(n, dtype=np.int32)
        in_group = at - np.maximum.accumulate(np.where(group, at, 0))
        place = first + in_group if slot is None else slot
        place = place[np.maximum.accumulate(np.where(new, at, 0))]
        rank[items] = place
        tie = ~new
        tie[:-1] |= ~new[1:]
        return items[tie], place[tie]

    def prefixes(self) -> np.ndarray:
        """Common prefix of each suffix with the one before it in order, by place
        in the text. Kasai's argument: if the bytes before both are equal, it is
        one less than the prefix one place before; so only the other places
        are compared byte for byte, eight at a time."""
        n = len(self.data)
        before = np.full(n, -1, np.int32)
        before[self.suffix[1:]] = self.suffix[:-1]
        start = np.append(True, self.of[1:] != self.of[:-1]) if n else np.zeros(0, bool)
        b = np.maximum(before, 0)
        fresh = start | (before < 0) | start[b] | (np.append(0, self.data[:-1]) != self.data[b - 1])
        del b
        at = np.flatnonzero(fresh & (before >= 0))
        most = np.minimum(self.left[at], self.left[before[at]])
        common = np.zeros(n, np.int32)
        word = _eight(self.data, "<u8")
        done = np.zeros(len(at), np.int32)
        go = np.arange(len(at))
        while len(go):
            x = at[go] + done[go]
            differ = word[x] ^ word[before[at[go]] + done[go]]
            # whole bytes that agree: zero bits below the lowest one that is set
            low = differ & (~differ + np.uint64(1))
            agree = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int32) // 8)
            done[go] += agree
            go = go[(agree == 8) & (done[go] < most[go])]
        common[at] = np.minimum(done, most)
        # the prefix shrinks by one a place until the next fresh one
        place = np.arange(n, dtype=np.int32)
        last = np.maximum.accumulate(np.where(fresh, place, 0))
        return np.where(before >= 0, common[last] - (place - last), 0)

    def repeated(self, length: int) -> np.ndarray:
        """Whether the string of ``length`` bytes at each place is elsewhere too."""
        common = self.prefixes()[self.suffix]
        twice = common >= length
        twice[:-1] |= common[1:] >= length
        return twice[self.rank]

    def groups(self, length: int) -> np.ndarray:
        """Number of the class of places that agree in ``length`` bytes."""
        return np.cumsum(self.prefixes()[self.suffix] < length)[self.rank]


_SPANS = f"{_KEY}, s long, e long"


def _shard(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """Repeats among a shard's contexts: spans (i, h, s, e) of what they cover,
    and for contexts of spread anchors one row (with d1 and d2) for each
    different string, to be looked up in other shards."""
    pdf = pdf.drop_duplicates(["anchor", "c"]).sort_values(["anchor", "c"], kind="stable")
    anchor, total = pdf["anchor"].to_numpy(), np.cumsum(pdf["bytes"].map(len).to_numpy())
    last = np.flatnonzero(np.append(anchor[1:] != anchor[:-1], True))  # row of each anchor
    cuts, done = [0], 0
    for row, this, following in zip(last.tolist(), total[last].tolist(), total[last[1:]].tolist(), strict=False):
        if following - done > PART:
            cuts.append(row + 1)
            done = this
    out = [_part(pdf.iloc[x:y], length) for x, y in zip(cuts, [*cuts[1:], len(pdf)], strict=True)]
    trim()
    return pd.concat([x for x in out if len(x)] or out[:1], ignore_index=True)


def _part(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """What ``_shard`` gives, of some of its anchors' contexts in order."""
    data = np.frombuffer(b"".join(pdf["bytes"]), np.uint8)
    size = pdf["bytes"].map(len).to_numpy()
    ends = np.concatenate([[0], np.cumsum(size)])
    sa = SuffixArray(data, ends)
    own = sa.left >= length
    twice = sa.repeated(length) & own
    i, h, a = (pdf[c].to_numpy() for c in ("i", "h", "a"))
    single, wide = pdf["single"].to_numpy(), pdf["wide"].to_numpy()
    # runs of repeated strings; contexts that occur twice whole are known already
    on = twice & single[sa.of]
    begin = on.copy()
    begin[1:] &= ~on[:-1] | (sa.of[1:] != sa.of[:-1])
    stop = on.copy()
    stop[:-1] &= ~on[1:] | (sa.of[1:] != sa.of[:-1])
    begin, stop = np.flatnonzero(begin), np.flatnonzero(stop)
    k = sa.of[begin]
    out = pd.DataFrame({"i": i[k], "h": h[k], "s": a[k] + begin - ends[k], "e": a[k] + stop - ends[k] + length, "d1": 0, "d2": 0, "known": True})
    if wide.any():
        at = np.flatnonzero(own & wide[sa.of])
        at = at[np.unique(sa.groups(length)[at], return_index=True)[1]]
        raw = data.tobytes()
        d = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[x : x + length]) for x in at.tolist()]), "<i8").reshape(-1, 2)
        k = sa.of[at]
        s = a[k] + at - ends[k]
        more = pd.DataFrame({"i": i[k], "h": h[k], "s": s, "e": s + length, "d1": d[:, 0], "d2": d[:, 1], "known": twice[at] | ~single[k]})
        more["shard"] = pdf["shard"].iloc[0]
        out = pd.concat([out.assign(shard=-1), more])
    else:
        out["shard"] = -1
    return out


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """Strings of a digest range that other shards hold as well: each shard's
    sorted run is looked up in the sorted rest by binary search."""
    pdf = pdf.sort_values(["d1", "d2"], kind="stable").reset_index(drop=True)
    d = np.empty(len(pdf), [("d1", "i8"), ("d2", "i8")])
    d["d1"], d["d2"] = pdf["d1"], pdf["d2"]
    key = np.cumsum(np.append(True, d[1:] != d[:-1]))  # digests in order, as numbers
    shard, hit = pdf["shard"].to_numpy(), np.zeros(len(pdf), bool)
    for one in np.unique(shard):
        mine = shard == one
        rest = key[~mine]
        if len(rest):
            at = np.minimum(np.searchsorted(rest, key[mine]), len(rest) - 1)
            hit[mine] = rest[at] == key[mine]
    return pdf.loc[hit & ~pdf["known"].to_numpy(), ["i", "h", "s", "e"]]


def _keyed(docs: DataFrame) -> DataFrame:
    """A row is known by its id and its text's hash, so rows that repeat an id
    differ, and rows that repeat both are alike."""
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("i"), F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))


def _named(docs: DataFrame, todo: DataFrame) -> DataFrame:
    """(i, h, text) of the texts that ``todo`` names, and a few others: no shuffle."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(todo.select(F.xxhash64("i", "h").alias("k"))))  # 8 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = in_bitmap(batch.column(3).to_numpy(), bits.value)
            if hit.any():
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(hit)) for c in batch.columns[:3]], names=["i", "h", "text"])
        trim()

    return docs.select("i", "h", "text", F.xxhash64("i", "h").alias("k")).mapInArrow(run, f"{_KEY}, text string")


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(i, h, s, e): byte spans of keyed documents that repeated strings cover; they may overlap."""
    rows = stored(anchors(docs, length, gram), "suffix-anchors")
    out, contested, total = [], [], 0
    for level in range(LEVELS):
        per = rows.groupBy("anchor", "c").agg(F.sum("times").alias("times"), F.min(F.struct("i", "h", "a", "span")).alias("one"))
        per = stored(per, "suffix-contexts")
        whole = rows.join(per.filter("times > 1").select("anchor", "c"), ["anchor", "c"])
        out.append(whole.select("i", "h", F.col("a").alias("s"), (F.col("b") + length).alias("e")))
        several = per.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
        both = stored(per.join(several, "anchor").select("anchor", "c", "n", (F.col("times") > 1).cast("long").alias("known"), "one.*"), "suffix-contested")
        few = F.lit(True) if level == LEVELS - 1 else F.col("n") <= SPREAD
        number, hot = both.agg(F.count_if(few), F.count_if(~few)).first()
        total += number
        contested.append(both.filter(few))
        if not hot:
            break
        todo = stored(both.filter(~few).groupBy("i", "h").agg(F.collect_list(F.struct("a", "span", "anchor", "known")).alias("todo")), "suffix-todo")
        rows = stored(finer(_named(docs, todo).join(todo, ["i", "h"]), length, longer(length, gram, level + 1), level + 1), "suffix-anchors")
    wanted = contested[0]
    for more in contested[1:]:
        wanted = wanted.union(more)
    shards = max(1, -(-total // SHARD))
    salt = F.pmod(F.col("c"), F.ceil(F.col("n") / SPREAD))
    wanted = wanted.select("i", "h", "a", "span", "anchor", "c", (F.col("known") == 0).alias("single"), (F.col("n") > SPREAD).alias("wide"), F.pmod(F.xxhash64("anchor", salt), F.lit(shards)).alias("shard"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, what, at, parts in _todo(batches, length):
            keys = [batch.column(batch.schema.names.index(k)).take(pa.array(at)) for k in ("i", "h")]
            cols = [pa.array([w[k] for w in what]) for k in ("a", "anchor", "c", "single", "wide", "shard")]
            yield pa.RecordBatch.from_arrays([*keys, *cols, pa.array(parts, pa.binary())], names=["i", "h", "a", "anchor", "c", "single", "wide", "shard", "bytes"])
        trim()

    todo = wanted.groupBy("i", "h").agg(F.collect_list(F.struct("a", "span", "anchor", "c", "single", "wide", "shard")).alias("todo"))
    pieces = docs.join(todo, ["i", "h"]).mapInArrow(cut, f"{_KEY}, a long, anchor long, c long, single boolean, wide boolean, shard long, bytes binary")
    found = pieces.groupBy("shard").applyInPandas(lambda pdf: _shard(pdf, length), f"{_SPANS}, d1 long, d2 long, known boolean, shard long")
    found = stored(found, "suffix-found")
    out.append(found.filter("shard < 0").select("i", "h", "s", "e"))
    wide = found.filter("shard >= 0")
    number = wide.count()
    if number:
        # digests are even, so ranges of them are; none holds more rows than RANGE or a digest in every shard
        ranges = max(-(-number // RANGE), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        out.append(wide.groupBy(F.pmod(F.shiftrightunsigned("d1", 32), F.lit(ranges))).applyInPandas(_merged, _SPANS))
    every = out[0]
    for more in out[1:]:
        every = every.union(more)
    return every


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left) of each row of ``docs``.

    Texts are UTF-8 bytes, null is empty, matches stay in a document and may
    overlap; strings are judged on the input. Rows that repeat id and text count
    as two documents, so all of either that is ``length`` long goes. Other
    columns are not read; an empty table gives no rows.
    """
    keyed = _keyed(docs)
    of_row = spans(keyed, length, gram).groupBy("i", "h").agg(F.collect_set(F.struct("s", "e")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.names.index
            ids, lists = batch.column(place("doc_id")), batch.column(place("spans"))
            for x, y, data, ends in utf8_slices(batch.column(place("text")), 2 * PART):
                n, gone, runs, kept = [], [], [], []
                raw = data.tobytes()
                for e0, e1, cut in zip(ends[:-1].tolist(), ends[1:].tolist(), lists[x:y].to_pylist(), strict=True):
                    at, parts, count = 0, [], 0
                    for s, e in _joined(cut or []):
                        parts.append(raw[e0 + at : e0 + s])
                        at, count = e, count + 1
                    parts.append(raw[e0 + at : e1])
                    left = b"".join(parts)
                    n.append(e1 - e0)
                    gone.append(e1 - e0 - len(left))
                    runs.append(count)
                    kept.append(left)
                yield pa.RecordBatch.from_arrays([ids[x:y], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
        trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed.join(of_row, ["i", "h"], "left").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def _joined(spans: list[dict]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap as one."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]
