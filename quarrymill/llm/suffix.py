"""Suffix-array dedup: removes every byte covered by a 100-byte string that also starts earlier in the corpus.

Each 100-byte window belongs to the least of its hashed 32-byte grams, so equal windows meet under the same gram
wherever they stand. Runs of windows with one gram are segments; only segments whose gram occurs again anywhere are
moved. Where a gram's segments differ, they are put together into shards, whose suffix arrays are built by induced
sorting and whose permuted common prefixes tell which windows are equal.

No gram gathers its segments in one place without bound. Grams with more than HOT segments anchor a window only where
it has no other gram, and segments of one gram beyond SHARD bytes meet again under longer anchors: a window that holds
a gram of n bytes also holds half the bytes that it can have before it, or half of those behind.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, numbered

WINDOW, GRAM = 100, 32
CHUNK = 1 << 20  # bytes of text that are hashed together
SHARD = 1 << 20  # bytes of segments in one suffix array
FLUSH = 1 << 20  # segments whose grams a task sends together
MOVE = 24 << 20  # bytes of text whose segments are cut out together
#: Segments from which a gram counts as hot: so many, and more where else over MOST_HOT grams would be hot.
HOT, MOST_HOT = 4096, 500_000
_PLACE = np.uint64((1 << 24) - 1)
_NO_ID = -(1 << 63)


# ---- suffix arrays


def _induce(t, s_type, lms, first, last):
    """Suffix array from LMS suffixes in (assumed) order. A bucket's suffixes are taken in waves: those already known,
    then those that these induce into the same bucket, and so on, which keeps the order of a scan one by one."""
    n, sigma = len(t), len(first)
    sa = np.full(n, -1, np.int64)
    chars = t[lms]
    per = np.bincount(chars, minlength=sigma)
    bounds = np.concatenate(([0], np.cumsum(per)))
    lms = lms[np.argsort(chars, kind="stable")]

    def spread(wave, want, ptr, step):
        j = wave - 1
        j = j[j >= 0]
        j = j[s_type[j] == want]
        if len(j):
            c = t[j]
            by = np.argsort(c, kind="stable")
            j, c = j[by], c[by]
            start = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            count = np.diff(np.append(start, len(c)))
            rank = np.arange(len(c)) - np.repeat(start, count)
            sa[ptr[c] + step * rank - (step < 0)] = j
            ptr[c[start]] += step * count

    used = np.flatnonzero(np.bincount(t, minlength=sigma))
    front = first.copy()
    for c in used:
        at = first[c]
        while at < front[c]:
            at, wave = front[c], sa[at : front[c]]
            spread(wave, False, front, 1)
        if per[c]:
            spread(lms[bounds[c] : bounds[c + 1]], False, front, 1)
    back = last.copy()
    sa[0], back[0] = n - 1, 0
    for c in used[::-1]:
        at = last[c]
        while at > back[c]:
            at, wave = back[c], sa[back[c] : at][::-1]
            spread(wave, True, back, -1)
        spread(sa[first[c] : front[c]][::-1], True, back, -1)
    return sa


def _induce_wide(t, s_type, lms, first, last):
    """The same, symbol by symbol: for strings of names, whose buckets are many and small."""
    symbols = t.tolist()
    # what may go before a suffix, by its type; the end goes before none, and stands for places not filled yet
    l_before, s_before = np.where(s_type, -1, t).tolist(), np.where(s_type, t, -1)
    s_before[-1] = -1
    s_before = s_before.tolist()
    sa, front, back = [0] * len(symbols), first.tolist(), last.tolist()
    for i in lms[::-1].tolist():
        c = symbols[i]
        back[c] = at = back[c] - 1
        sa[at] = i
    for i in sa:  # what is filled in ahead is met later in the same pass
        i -= 1
        c = l_before[i]
        if c >= 0:
            at = front[c]
            sa[at] = i
            front[c] = at + 1
    back = last.tolist()
    for i in reversed(sa):
        i -= 1
        c = s_before[i]
        if c >= 0:
            back[c] = at = back[c] - 1
            sa[at] = i
    return np.array(sa)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of symbols 1.. followed by one 0, by induced sorting: leftmost-smaller substrings are put in order
    and named, names that recur are ordered by the suffix array of the string of names, and the rest is induced."""
    n, sigma = len(t), int(t.max(initial=0)) + 1
    induce = _induce if sigma <= 512 else _induce_wide
    count = np.bincount(t, minlength=sigma)
    last = np.cumsum(count)
    first = last - count
    # S-type: smaller than the next suffix; equal neighbours are of the type of the run's end
    rise = np.zeros(n, np.int8)
    rise[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1])
    rise[-1] = 1
    ends = np.where(rise != 0, np.arange(n), n - 1)
    ends = np.minimum.accumulate(ends[::-1])[::-1]
    s_type = rise[ends] > 0
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    if len(lms) > 1:
        place = np.full(n, -1, np.int64)
        place[lms] = np.arange(len(lms))
        rough = induce(t, s_type, lms, first, last)
        by = rough[place[rough] >= 0]
        size = np.diff(np.append(lms, n))[place[by]] + 1  # up to and with the next LMS symbol
        same = np.zeros(len(by), bool)
        open_ = np.flatnonzero(size[1:] == size[:-1]) + 1
        k = 0
        while len(open_):
            full = k >= size[open_]
            same[open_[full]] = True
            open_ = open_[~full]
            a, b = by[open_] + k, by[open_ - 1] + k
            fits = (a < n) & (b < n)
            fits[fits] = t[a[fits]] == t[b[fits]]
            open_ = open_[fits]
            k += 1
        names = np.empty(len(lms), np.int64)
        names[place[by]] = np.cumsum(~same) - 1
        lms = by if not same.any() else lms[suffix_array(np.append(names + 1, 0))[1:]]
    return induce(t, s_type, lms, first, last)


def permuted_lcp(raw: np.ndarray, sa: np.ndarray, room: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, cut at the ends of segments. room: bytes left in
    the segment; fresh: where a segment starts. Only values not given by the neighbour's are compared."""
    n = len(raw)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    given = (before > 0) & ~fresh & (i > 0)
    given[given] = ~fresh[before[given]]
    given[given] = raw[i[given] - 1] == raw[before[given] - 1]
    padded = np.concatenate((raw, np.zeros(8, np.uint8))).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word |= padded[k : k + n] << np.uint64(8 * k)
    out = np.zeros(n, np.int64)
    at = np.flatnonzero(~given & (before >= 0))
    other, limit, done = before[at], np.minimum(room[at], room[before[at]]), 0
    while len(at):
        x = word[np.minimum(at + done, n - 1)] ^ word[np.minimum(other + done, n - 1)]
        equal = np.full(len(at), 8, np.int64)
        some = x != 0
        low = x[some] & (~x[some] + np.uint64(1))
        equal[some] = np.log2(low.astype(np.float64)).astype(np.int64) // 8
        out[at] = np.minimum(done + equal, limit)
        more = (equal == 8) & (done + 8 < limit)
        at, other, limit = at[more], other[more], limit[more]
        done += 8
    lead = np.maximum.accumulate(np.where(given, 0, i))
    return np.where(given, np.maximum(out[lead] - (i - lead), 0), out)


def repeated_windows(segments: list[bytes], order: np.ndarray, window: int = WINDOW):
    """Yields (segment, first, last) for runs of windows of a shard that also start earlier. order: for each segment a
    number to which a window's offset is added, least first."""
    size = np.fromiter(map(len, segments), np.int64, len(segments))
    raw = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    owner = np.repeat(np.arange(len(segments)), size + 1)
    offset = np.arange(len(raw)) - start[owner]
    room = size[owner] - offset
    t = np.append(np.where(room == 0, 1, raw.astype(np.int64) + 2), 0)
    sa = suffix_array(t)[1:]
    lcp = permuted_lcp(raw, sa, room, offset == 0)
    group = np.cumsum(lcp[sa] < window)
    valid = room[sa] >= window
    at, group = sa[valid], group[valid]
    if not len(at):
        return
    key = order[owner[at]] + offset[at]
    edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    least = np.repeat(np.minimum.reduceat(key, edge), np.diff(np.append(edge, len(at))))
    flag = np.zeros(len(raw) + 1, np.int8)
    flag[at[key != least]] = 1
    change = np.diff(flag, prepend=0)
    for a, b in zip(np.flatnonzero(change == 1), np.flatnonzero(change == -1)):
        yield owner[a], int(offset[a]), int(offset[b - 1])


# ---- segments


def segments(texts: list[bytes]):
    """(text, start, windows, gram hash, gram's offset) arrays: runs of windows that have their least gram in one place."""
    out = [[], [], [], [], []]
    held, n = [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text)), CHUNK):  # very long texts in pieces that overlap by a window
            piece = text[at : at + CHUNK + WINDOW - 1]
            if len(piece) >= WINDOW:
                held.append((k, at, piece))
                n += len(piece)
            if n >= CHUNK:
                _grams(held, out)
                held, n = [], 0
    _grams(held, out)
    return _joined(out)


def _joined(out):
    return [np.concatenate([np.empty(0, np.uint64 if k == 3 else np.int64), *x]) for k, x in enumerate(out)]


def _grams(held, out, hot=None):
    """hot: sorted hashes of grams that are taken only where a window has no other."""
    if not held:
        return
    size = np.array([len(p) for _, _, p in held])
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    h = np.frombuffer(b"".join(p for _, _, p in held), np.uint8).astype(np.uint64) + np.uint64(1)
    span, base = 1, 0x9E3779B97F4A7C15
    while span < GRAM:
        h = h[:-span] * np.uint64(base) + h[span:]
        base = base * base % (1 << 64)
        span *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    weight = h
    if hot is not None:
        at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
        weight = (h >> np.uint64(1)) | ((hot[at] == h).astype(np.uint64) << np.uint64(63))
    least = (weight & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    span, width = 1, WINDOW - GRAM + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    place = (least & _PLACE).astype(np.int64)
    # windows that begin in one text and end in the next are no windows
    inside = np.ones(len(place), bool)
    for k in range(1, WINDOW):
        at = start[1:] - k
        inside[at[(at >= 0) & (at < len(place))]] = False
    new = np.concatenate(([True], (place[1:] != place[:-1]) | ~inside[:-1]))
    first = np.flatnonzero(new & inside)
    stop = np.flatnonzero(new | ~inside)
    stop = np.append(stop, len(place))[np.searchsorted(stop, first, side="right")]
    owner = np.searchsorted(start, first, side="right") - 1
    out[0].append(np.array([k for k, _, _ in held])[owner])
    out[1].append(first - start[owner] + np.array([at for _, at, _ in held])[owner])
    out[2].append(stop - first)
    out[3].append(h[place[first]])
    out[4].append(place[first] - first)


# ---- Spark stages

_SENT = "bucket int, known boolean, doc binary, uid binary, pos binary, gram binary"
_MARKED = "doc_id long, uid long, pos long, gram long"
#: Moved segments with their anchor's offset and length; rows without a segment are ranges that go.
_MOVED = "gram long, segment binary, doc_id long, uid long, start long, stop long, anchor int, size int"
_GONE = "gram segment doc_id uid start stop anchor size"


def _columns(names, *arrays):
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays], names=names.split())


def _send_grams(buckets: int):
    """Every segment's gram, by bucket of its hash. Of a gram that recurs within a task's part, one occurrence is sent
    to be counted; the others are known to recur and go to a bucket of their document."""

    def flush(parts):
        doc, uid, pos, gram = (np.concatenate([p[k] for p in parts]) for k in range(4))
        by = np.argsort(gram, kind="stable")
        doc, uid, pos, gram = doc[by], uid[by], pos[by], gram[by]
        first = np.concatenate(([True], gram[1:] != gram[:-1])) if len(gram) else np.empty(0, bool)
        twice = np.append(first[1:], True) & first  # alone in this part
        known = ~twice
        # all occurrences of a recurring gram are known; its first one also tells other parts of the gram
        yield from rows(doc[known], uid[known], pos[known], gram[known], True, (doc[known].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33))
        yield from rows(doc[first], uid[first], np.where(twice, pos, -1)[first], gram[first], False, gram[first] >> np.uint64(33))

    def rows(doc, uid, pos, gram, known, spread):
        bucket = (spread % np.uint64(buckets)).astype(np.int32)
        by = np.argsort(bucket, kind="stable")
        edge = np.flatnonzero(np.diff(bucket[by], prepend=-1))
        parts = [(bucket[by[a]], by[a:b]) for a, b in zip(edge, np.append(edge[1:], len(by)))]
        if parts:
            blob = lambda x: pa.array([x[at].tobytes() for _, at in parts], pa.binary())
            yield _columns("bucket known doc uid pos gram", pa.array([k for k, _ in parts], pa.int32()), [known] * len(parts), blob(doc), blob(uid), blob(pos), blob(gram))

    def run(batches):
        parts, n = [], 0
        for batch in batches:
            doc, uid = batch["doc_id"].to_numpy(), batch["uid"].to_numpy()
            text, start, windows, gram, anchor = segments([x.as_py() for x in batch["bytes"]])
            parts.append((doc[text], uid[text], start << 14 | anchor << 7 | windows, gram))
            n += len(text)
            if n >= FLUSH:
                yield from flush(parts)
                parts, n = [], 0
        if n:
            yield from flush(parts)

    return run


def _mark_repeated(batches):
    """Of rows in order of their buckets, the segments whose gram occurs more than once. A part's first occurrence of a
    gram that recurs within it comes without a position: it only counts, as the segment itself is known already."""

    def settled(held):
        doc, uid, pos, gram = (np.concatenate([h[k] for h in held]) for k in range(4))
        by = np.argsort(gram, kind="stable")
        again = gram[by][1:] == gram[by][:-1]
        keep = by[(np.append(again, False) | np.concatenate(([False], again)))]
        keep = keep[pos[keep] >= 0]
        return _columns("doc_id uid pos gram", doc[keep], uid[keep], pos[keep], gram[keep])

    held, bucket = [], None
    for batch in batches:
        known, buckets = batch["known"].to_numpy(zero_copy_only=False), batch["bucket"].to_numpy()
        parts = [[np.frombuffer(x.as_py(), np.int64) for x in batch[c]] for c in ("doc", "uid", "pos", "gram")]
        for k in range(batch.num_rows):
            one = [p[k] for p in parts]
            if held and buckets[k] != bucket:
                yield settled(held)
                held = []
            bucket = buckets[k]
            if known[k]:
                yield _columns("doc_id uid pos gram", *one)
            else:
                held.append(one)
    if held:
        yield settled(held)


def _merge(start: np.ndarray, stop: np.ndarray):
    """Union of ranges that may touch."""
    by = np.argsort(start, kind="stable")
    start, stop = start[by], np.maximum.accumulate(stop[by])
    new = np.concatenate(([True], start[1:] > stop[:-1])) if len(start) else np.empty(0, bool)
    return start[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)] if len(start) else stop


def _move_segments(hot):
    """Marked segments with their bytes. Of equal segments in a batch only the earliest is moved; the ranges of the
    others are known to go and are passed on as they are. Segments of hot grams are anchored anew (hot: their sorted
    hashes, sent to every task)."""

    def moved(rows, hot_now):
        found, warm, gone = {}, {}, []
        for doc, uid, text, pos, gram in sorted(rows, key=lambda r: r[:2]):
            go = [(0, len(text))] if (pos < 0).any() else []
            by = np.argsort(pos, kind="stable")[: 0 if go else None]
            at = np.minimum(np.searchsorted(hot_now, gram.view(np.uint64)), max(0, len(hot_now) - 1))
            is_hot = hot_now[at] == gram.view(np.uint64) if len(hot_now) else np.zeros(len(gram), bool)
            for p, g, h in zip(pos[by].tolist(), gram[by].tolist(), is_hot[by].tolist()):
                a, b = p >> 14, (p >> 14) + (p & 127) + WINDOW - 1
                first = (warm if h else found).setdefault((g, text[a:b]), (doc, uid, a, p >> 7 & 127))
                if first[:3] != (doc, uid, a):
                    go.append((a, b))
            gone += [(doc, uid, *r) for r in zip(*_merge(*np.array(go, np.int64).T))] if go else []
        if warm:
            places, out = list(warm.values()), [[], [], [], [], []]
            _grams([(k, 0, seg) for k, (_, seg) in enumerate(warm)], out, hot_now)
            segs = [seg for _, seg in warm]
            text, start, windows, gram, anchor = _joined(out)
            for k, a, w, g, x in zip(text.tolist(), start.tolist(), windows.tolist(), gram.view(np.int64).tolist(), anchor.tolist()):
                doc, uid, at, _ = places[k]
                key, place = (g, segs[k][a : a + w + WINDOW - 1]), (doc, uid, at + a, x)
                first = found.setdefault(key, place)
                if first != place:
                    found[key], late = min(first, place), max(first, place)
                    gone.append((*late[:3], late[2] + len(key[1])))
        if gone:
            doc, uid, a, b = np.array(gone, np.int64).T
            none = pa.nulls(len(a), pa.int32())
            yield _columns(_GONE, doc ^ 0x5DEECE66D, pa.nulls(len(a), pa.binary()), doc, uid, a, b, none, none)
        if found:
            doc, uid, a, x = (np.array(c, np.int64) for c in zip(*found.values()))
            gram = np.array([g for g, _ in found], np.int64)
            yield _columns(_GONE, gram, pa.array([s for _, s in found], pa.binary()), doc, uid, a, a, x.astype(np.int32), np.full(len(a), GRAM, np.int32))

    def run(batches):
        hot_now = hot.value
        for batch in batches:
            rows, n = [], 0
            for doc, uid, text, pos, gram in zip(batch["doc_id"].to_pylist(), batch["uid"].to_pylist(), batch["bytes"], batch["pos"], batch["gram"]):
                rows.append((doc, uid, text.as_py(), pos.values.to_numpy(), gram.values.to_numpy()))
                n += len(rows[-1][2])
                if n >= MOVE:
                    yield from moved(rows, hot_now)
                    rows, n = [], 0
            yield from moved(rows, hot_now)

    return run


def _halves(seg: bytes, x: int, size: int):
    """A segment whose windows all hold the bytes x to x + size, as up to two with a longer anchor: (key, first byte,
    bytes, anchor's offset, anchor's size)."""
    half = (WINDOW - size + 1) // 2
    # windows start at 0 to len(seg) - WINDOW; those that start `half` or more before the anchor hold as much before it
    for low, high, at, side in ((0, x - half, x - half, b"l"), (max(0, x - half + 1), len(seg) - WINDOW, x, b"r")):
        high = min(high, len(seg) - WINDOW)
        if low <= high:
            key = int.from_bytes(hashlib.blake2b(seg[at : at + size + half], digest_size=8, key=side).digest(), "little", signed=True)
            yield key, low, seg[low : high + WINDOW], at - low, size + half


def _cut_repeats(shard_bytes: int):
    """Moved segments in order of their grams, to the ranges that go, and to segments with longer anchors where a gram
    has more than shard_bytes of different ones. Equal segments are one text with many places."""

    def run(batches):
        shard: list = []  # (segment, doc, uid, start) of the earliest place of texts that share a gram with another
        group, size, group_size, gram_now, spill = {}, 0, 0, None, False

        def shards():
            segs = [s for s, *_ in shard]
            doc, uid, start = (np.array(x, np.int64) for x in zip(*(r[1:] for r in shard)))
            _, rank = np.unique(np.stack((doc, uid), axis=1), axis=0, return_inverse=True)
            hit = [(k, a, b) for k, a, b in repeated_windows(segs, (rank.reshape(-1).astype(np.int64) << 40) + start)]
            if hit:
                k, a, b = np.array(hit, np.int64).T
                yield from ranges(zip(doc[k].tolist(), uid[k].tolist(), (start[k] + a).tolist(), (start[k] + b + WINDOW).tolist()))

        def ranges(gone):
            doc, uid, a, b = np.array(list(gone), np.int64).T
            none = pa.nulls(len(a), pa.int32())
            yield _columns(_GONE, pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.binary()), doc, uid, a, b, none, none)

        def passed_on(rows):
            """rows (segment, doc, uid, start, anchor, size) to be met again under longer anchors."""
            out = [(key, part, doc, uid, start + low, start + low, at, n) for seg, doc, uid, start, x, size in rows for key, low, part, at, n in _halves(seg, x, size)]
            for k in range(0, len(out), 20_000):
                cols = list(zip(*out[k : k + 20_000]))
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield _columns(_GONE, *(pa.array(c, t) for c, t in zip(cols, kinds)))

        def close():
            nonlocal size, group_size, spill
            if len(group) > 1:
                if size and size + group_size > shard_bytes:
                    yield from shards()
                    shard.clear()
                    size = 0
                shard.extend((seg, *place[:3]) for seg, place in group.items())
                size += group_size
            group.clear()
            group_size, spill = 0, False

        for batch in batches:
            gone, more = [], []
            rows = zip(*(batch[c].to_pylist() for c in _GONE.split()))
            for gram, seg, doc, uid, start, stop, x, length in rows:
                if seg is None:
                    gone.append((doc, uid, start, stop))
                    continue
                if gram != gram_now:
                    yield from close()
                    gram_now = gram
                if spill:
                    more.append((seg, doc, uid, start, x, length))
                    continue
                place = (doc, uid, start, x, length)
                had = group.get(seg)
                if had is None:
                    group[seg] = place
                    group_size += len(seg) + 1
                else:
                    late = max(had, place)
                    group[seg] = min(had, place)
                    gone.append((late[0], late[1], late[2], late[2] + len(seg)))
                if group_size > shard_bytes and len(group) > 1 and length < WINDOW:
                    more += [(s, *p) for s, p in group.items()]
                    group.clear()
                    spill, group_size = True, 0
            if gone:
                yield from ranges(gone)
            if more:
                yield from passed_on(more)
        yield from close()
        if shard:
            yield from shards()

    return run


def _spans(starts, stops):
    if starts is None or not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return _merge(np.asarray(starts, np.int64), np.asarray(stops, np.int64))


def _later_copies(rows: DataFrame) -> DataFrame:
    """Documents that are byte for byte an earlier one, marked by position -1: they go as a whole, so that none of
    their segments need be moved. Only digests and ids are shuffled, summed first."""
    digest = rows.where(F.octet_length("bytes") >= WINDOW).select("doc_id", "uid", F.sha2("bytes", 256).alias("h"))
    firsts = digest.groupBy("h").agg(F.min(F.struct("doc_id", "uid")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = digest.join(firsts, "h").where(F.struct("doc_id", "uid") != F.col("first"))
    return later.select("doc_id", "uid", F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("gram"))


def repeated_spans(docs: DataFrame, scratch: Scratch, carry: tuple[str, ...] = ()) -> DataFrame:
    """documents (doc_id, text) as rows (doc_id, bytes, starts, stops, rest: a struct of the columns to carry): the text as UTF-8
    and, unmerged, the byte ranges that repeat.

    Rows that repeat an id, and rows without one, are documents of their own: they are ordered by id (null first), then
    in the order of a table kept for the purpose. Null texts are empty, and have no ranges, like texts below 100 bytes;
    very long texts are hashed in pieces that overlap by a window; an empty table gives an empty one. Texts are shuffled
    once, by document: both joins read the same columns of it, so that Spark reuses the exchange."""
    spark = docs.sparkSession
    rows, ids, number = numbered(docs, "doc_id", scratch)
    ids = ["doc_id", "uid"][: len(ids)]
    rest = [F.struct(*carry).alias("rest")] if carry else []
    rows = rows.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.col(number).alias("uid"), F.coalesce("text", F.lit("")).cast("binary").alias("bytes"), *rest
    )
    texts = rows.columns
    buckets = 16 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grams = rows.where(F.octet_length("bytes") >= WINDOW).select("doc_id", "uid", "bytes").mapInArrow(_send_grams(buckets), _SENT)
    marked = grams.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_mark_repeated, _MARKED)
    marked = scratch.keep(marked.unionByName(_later_copies(rows)), "marked")
    counts = marked.where("pos >= 0").groupBy("gram").count().where(F.col("count") > max(HOT, marked.count() // MOST_HOT))
    hot = spark.sparkContext.broadcast(np.sort(np.array([r["gram"] for r in counts.select("gram").collect()], np.int64).view(np.uint64)))  # MOST_HOT at most
    lists = marked.groupBy(*ids).agg(F.collect_list("pos").alias("pos"), F.collect_list("gram").alias("gram"))
    moved = rows.join(lists.hint("shuffle_hash"), ids).select(*texts, "pos", "gram").mapInArrow(_move_segments(hot), _MOVED)
    cuts = None
    for level in range(8):  # an anchor takes 7 halvings to grow to a window, and equal windows are one segment
        here = scratch.keep(moved.repartition("gram").sortWithinPartitions("gram").mapInArrow(_cut_repeats(SHARD), _MOVED), f"cuts-{level}")
        cuts = here if cuts is None else cuts.unionByName(here)
        moved = here.where("segment is not null")
        if level == 0:
            scratch.drop("marked")
        if moved.isEmpty():
            break
    spans = cuts.where("segment is null").groupBy(*ids).agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    out = rows.join(spans.hint("shuffle_hash"), ids, "left").withColumn("doc_id", F.nullif("doc_id", F.lit(_NO_ID)))
    return out.select("doc_id", "bytes", "starts", "stops", *(["rest"] if carry else []))


def without_repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """documents with the repeats cut out of their texts and n_chars counted anew; texts may become empty, no row is
    lost. A null text without repeats becomes empty."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    spans = repeated_spans(docs, scratch, carry)

    @F.arrow_udf("string")
    def left(texts: pa.Array, starts: pa.Array, stops: pa.Array) -> pa.Array:
        return pa.array([without_spans(t.as_py(), a.as_py(), b.as_py()) for t, a, b in zip(texts, starts, stops)], pa.string())

    out = spans.withColumn("text", left("bytes", "starts", "stops"))
    shown = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[shown[c] if c in shown else F.col("rest").getField(c) for c in docs.columns]).toDF(*docs.columns)


def digests(spans: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            for text, starts, stops in zip(batch["bytes"], batch["starts"], batch["stops"]):
                text = text.as_py()
                a, b = _spans(starts.as_py(), stops.as_py())
                kept, at = hashlib.sha256(), 0
                for x, y in zip(a.tolist(), b.tolist()):
                    kept.update(text[at:x])
                    at = y
                kept.update(text[at:])
                out.append((len(text), int((b - a).sum()), len(a), kept.hexdigest()))
            n, gone, runs, sha = zip(*out) if out else ((), (), (), ())
            yield _columns("doc_id n_bytes n_removed n_spans kept_sha256", batch["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string()))

    return spans.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_spans(text: bytes, starts, stops) -> str:
    """The text left over. A character goes only if all its bytes go, so that what is left is text."""
    out, at = [], 0
    for x, y in zip(*(s.tolist() for s in _spans(starts, stops))):
        while x > 0 and x < len(text) and text[x] & 0xC0 == 0x80:
            x += 1
        while y < len(text) and y > x and text[y] & 0xC0 == 0x80:
            y -= 1
        if y > x:
            out.append(text[at:x])
            at = y
    return b"".join((*out, text[at:])).decode("utf-8", "replace")


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`repeated_spans` over all documents; its docstring states nulls, long texts, repeated rows and empty tables. Columns
    besides doc_id and text, whatever their names, are not read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(repeated_spans(docs, Scratch(spark, "suffix")))
