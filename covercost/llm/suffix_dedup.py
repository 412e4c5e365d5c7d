"""Operator 5: removal of byte strings of LENGTH bytes that start more than once in the corpus, by suffix arrays.

Equal strings are brought together first.  In every run of LENGTH bytes the
ANCHOR-byte window of the least hash is an anchor (winnowing), so equal strings
have equal anchors at equal places.  Around an anchor that occurs more than
once, a segment holds every string that it anchors.  Segments that are equal
are duplicates throughout.  The others are compared (of equal segments one):
each string around an anchor holds one of PARTS spans of CORE bytes, segments
are grouped by the hashes of these spans, and the groups are packed into shards
whose suffix arrays are built by induced sorting.  Within a group the span is
the same everywhere, so a shard holds it as one symbol between the bytes before
and after it.  Suffixes whose common prefix (permuted, by text position) with a
neighbour covers LENGTH bytes or more are duplicates when they stand in one
group.  A group of more than MOST_SEGMENTS segments isn't put into one shard:
its equal pieces are brought together, and if more than MOST_SEGMENTS distinct
ones are left, these are cut again into parts of fewer strings with a longer
core, which fall into smaller groups.  Parts of the last of the WIDTHS are one
string each, and equal throughout.

Induced sorting runs over byte buckets with whole arrays; the string of names
of the leftmost-smaller substrings, whose alphabet is as long as itself, is
ordered by doubling.

Defined cases: null text is empty; texts of under LENGTH bytes lose nothing;
every row is a document, so a repeated row is a copy of the other; strings
never cross documents; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covercost.llm.base import broadcast_if_small, mix, powers, prefix_hashes, scratch, slices, span_hashes, stage, stream, table, text_bytes
from covercost.llm.minhash_dedup import by_key

LENGTH, ANCHOR = 200, 40
REACH = LENGTH - ANCHOR  # bytes on either side of an anchor that its strings may hold
PARTS = 4
CORE = LENGTH - REACH // PARTS
#: Places that strings may have in a part, at first and where groups are cut again: a string is as many symbols, its core being one.
WIDTHS = (LENGTH - CORE + 1, 11, 1)
#: Segments that a group may put into one shard, and symbols that one suffix array covers.
MOST_SEGMENTS, ARRAY_SYMBOLS = 1024, 1 << 19
_LEFT, _RIGHT = stream(51, 2)
_VALUES = stream(52, 259)
_PLACES = stream(53, WIDTHS[0])
_BASE = 0xC2B2AE3D27D4EB4F
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def text_of() -> F.Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def key_of(text: F.Column) -> F.Column:
    """16 bytes of the text's SHA-256."""
    return F.unhex(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 32))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray):
    """(document, position, anchor hash, segment hash) of every anchor."""
    prefix = prefix_hashes(data)
    at = np.arange(max(0, len(data) - ANCHOR + 1))
    hashes = span_hashes(prefix, at, at + ANCHOR)
    least = sliding_least((hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), REACH + 1)
    start = np.arange(len(least))
    doc = np.searchsorted(offsets, start, side="right") - 1
    inside = start + LENGTH <= offsets[doc + 1] if len(start) else np.zeros(0, bool)
    place = np.unique((least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64))
    doc = np.searchsorted(offsets, place, side="right") - 1
    lo, hi = np.maximum(offsets[doc], place - REACH), np.minimum(offsets[doc + 1], place + LENGTH)
    segment = mix(span_hashes(prefix, lo, hi) + (place - lo).astype(np.uint64) * _LEFT + (hi - place).astype(np.uint64) * _RIGHT)
    return doc, place - offsets[doc], hashes[place], segment


def occurrences(texts: DataFrame) -> DataFrame:
    def find(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in slices(offsets):
                own = offsets[lo:hi + 1] - offsets[lo]
                doc, pos, anchor, segment = anchors(data[offsets[lo]:offsets[hi]], own)
                yield pa.record_batch([batch.column(0).take(pa.array(lo + doc)), pa.array(pos), pa.array(anchor.view(np.int64)), pa.array(segment.view(np.int64))],
                                      names=["key", "pos", "anchor", "segment"])

    return texts.mapInArrow(find, "key binary, pos long, anchor long, segment long")


def parts(lo: np.ndarray, hi: np.ndarray, place: np.ndarray):
    """For each part: (part, rows, core start, first and end byte of the part's strings) of the segments long enough."""
    step = REACH // PARTS
    for p in range(PARTS):
        core = place - p * step  # strings that begin in (core - step, core], the last part's first one included
        a = np.maximum(lo, core - step + (p < PARTS - 1))
        b = np.minimum(hi, core + LENGTH)
        rows = np.flatnonzero((core >= lo) & (core + CORE <= hi) & (b - a >= LENGTH))
        yield p, rows, core[rows], a[rows], b[rows]


def without_core(data: np.ndarray, a: np.ndarray, before: np.ndarray, core: int, size: np.ndarray) -> pa.Array:
    """The ``size`` bytes of each span that starts at ``a``, without the ``core`` bytes that follow its first ``before``."""
    ends = np.concatenate(([0], np.cumsum(size)))
    within = np.arange(ends[-1]) - np.repeat(ends[:-1], size)
    data = data[np.repeat(a, size) + within + core * (within >= np.repeat(before, size))]
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


PIECE = ["group", "key", "start", "left", "around", "known"]
PIECES = "group long, key binary, start long, left int, around binary, known boolean"


def cut_out(members: DataFrame) -> DataFrame:
    """A row for each part of each segment: its group (the core's hash), place, whether it is known to be repeated, and
    the bytes before (``left`` of them) and after the core."""

    def cut(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            spots = batch.column(2)
            of = spots.offsets.to_numpy() - spots.offsets[0].as_py()
            values = spots.flatten()
            pos, known = values.field("pos").to_numpy(), values.field("known")
            for lo, hi in slices(offsets):
                own = offsets[lo:hi + 1] - offsets[lo]
                raw = data[offsets[lo]:offsets[hi]]
                prefix = prefix_hashes(raw)
                doc = np.repeat(np.arange(hi - lo), np.diff(of[lo:hi + 1]))
                place = own[doc] + pos[of[lo]:of[hi]]
                for p, rows, core, a, b in parts(np.maximum(own[doc], place - REACH), np.minimum(own[doc + 1], place + LENGTH), place):
                    group = mix(span_hashes(prefix, core, core + CORE) + np.uint64(p + 1)).view(np.int64)
                    around = without_core(raw, a, core - a, CORE, b - a - CORE)
                    yield pa.record_batch([pa.array(group), batch.column(0).take(pa.array(lo + doc[rows])), pa.array(a - own[doc[rows]]),
                                           pa.array((core - a).astype(np.int32)), around, known.take(pa.array(of[lo] + rows))], names=PIECE)

    return members.mapInArrow(cut, PIECES)


def cut_finer(pieces: DataFrame, width: int, narrower: int) -> DataFrame:
    """The strings of ``pieces``, which have ``width`` places, in parts of ``narrower`` neighbouring places.

    What the strings of a part have in common besides the old core (``shared``
    bytes around it) joins the core, and so tells the part's group.
    """
    shared = width - narrower

    def cut(batches):
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                part = batch.slice(lo, 2000)
                group, key, start, left, around, known = part.columns
                data, offsets = text_bytes(around.cast(pa.large_binary()))
                prefix, first, end = prefix_hashes(data), offsets[:-1], offsets[1:]
                for place in range(0, shared + 1, max(1, narrower - 1)):  # neighbouring parts may have a place in common
                    core = first + left.to_numpy() - place
                    a, b = np.maximum(first, core - narrower + 1), np.minimum(end, core + shared + narrower - 1)
                    rows = np.flatnonzero((core >= first) & (core + shared <= end) & (b - a >= width - 1))
                    at, core, a, b = pa.array(rows), core[rows], a[rows], b[rows]
                    finer = mix(span_hashes(prefix, core, core + shared) + group.to_numpy().view(np.uint64)[rows] * _LEFT + _PLACES[place])
                    yield pa.record_batch([pa.array(finer.view(np.int64)), key.take(at), pa.array(start.to_numpy()[rows] + a - first[rows]), pa.array((core - a).astype(np.int32)),
                                           without_core(data, a, core - a, shared, b - a - shared), known.take(at)], names=PIECE)

    return pieces.mapInArrow(cut, PIECES)


def kinds(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than their successor; the last one (the sentinel) is."""
    d = np.sign(s[1:] - s[:-1])
    change = np.flatnonzero(d)
    small = np.ones(len(s), bool)
    small[:-1] = d[change[np.searchsorted(change, np.arange(len(d)))]] > 0
    return small


def induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """Suffix array induced from leftmost-smaller suffixes in the order given."""

    def deal(into: list[list], at: np.ndarray, kind: bool) -> None:
        before = at[at > 0] - 1
        before = before[small[before] == kind]
        if len(before):
            c = s[before]
            order = np.argsort(c, kind="stable")
            before, c = before[order], c[order]
            cuts = np.flatnonzero(c[1:] != c[:-1]) + 1
            for part, first in zip(np.split(before, cuts), c[np.concatenate(([0], cuts))].tolist(), strict=True):
                into[first].append(part)

    order = lms[np.argsort(s[lms], kind="stable")]
    bounds = np.searchsorted(s[order], np.arange(size + 1))
    large: list[list] = [[] for _ in range(size)]
    for c in range(size):
        for part in large[c]:  # grows while it is read
            deal(large, part, False)
        deal(large, order[bounds[c]:bounds[c + 1]], False)
    whole = [np.concatenate(x) if x else order[:0] for x in large]
    falling: list[list] = [[] for _ in range(size)]
    falling[0].append(np.array([len(s) - 1]))
    for c in range(size - 1, -1, -1):
        for part in falling[c]:
            deal(falling, part, True)
        deal(falling, whole[c][::-1], True)
    return np.concatenate([x for c in range(size) for x in (whole[c], np.concatenate(falling[c])[::-1] if falling[c] else order[:0])])


def suffix_array(s: np.ndarray, size: int = 258) -> np.ndarray:
    """Suffix array of ``s``, whose last value is 0 and occurs nowhere else."""
    if len(s) < 2:
        return np.arange(len(s))
    small = kinds(s)
    first = np.zeros(len(s), bool)
    first[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(first)
    order = induce(s, small, lms, size)
    order = order[first[order]]
    # names: equal substrings (up to the next leftmost-smaller place) have equal hashes
    ends = np.append(lms[1:], len(s) - 1) + 1
    sums = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(_VALUES[s] * powers(_BASE, len(s)), out=sums[1:])
    named = mix((sums[ends] - sums[lms]) * powers(_BASE_INVERSE, len(s) + 1)[lms])
    place = np.searchsorted(lms, order)
    new = np.ones(len(order), bool)
    new[1:] = named[place][1:] != named[place][:-1]
    name = np.empty(len(lms), np.int64)
    name[place] = np.cumsum(new)
    width = 1
    while True:  # the order of the suffixes of the names, by doubling
        ahead = np.zeros(len(name), np.int64)
        ahead[:-width] = name[width:] if width < len(name) else ahead[:-width]
        pair = name * (len(name) + 2) + ahead
        place = np.argsort(pair, kind="stable")
        new = np.ones(len(place), bool)
        new[1:] = pair[place][1:] != pair[place][:-1]
        name[place] = np.cumsum(new)
        width *= 2
        if new.all():
            return induce(s, small, lms[place], size)


def common_prefixes(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each text position the length, up to ``most``, of its common prefix with its predecessor in the array."""
    before = np.full(len(s), -1)
    before[sa[1:]] = sa[:-1]
    sums = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(_VALUES[s] * powers(_BASE, len(s)), out=sums[1:])
    back = powers(_BASE_INVERSE, len(s) + 1)
    at = np.flatnonzero(before >= 0)
    other = before[at]
    low = np.zeros(len(at), np.int64)
    step = 1 << (most.bit_length() - 1)
    while step:
        want = np.minimum(low + step, most)
        fits = np.maximum(at, other) + want <= len(s)
        x, y = np.where(fits, at + want, 0), np.where(fits, other + want, 0)
        same = fits & ((sums[x] - sums[at]) * back[at] == (sums[y] - sums[other]) * back[other])
        low[same] = want[same]
        step //= 2
    out = np.zeros(len(s), np.int64)
    out[at] = low
    return out


def repeated(data: np.ndarray, offsets: np.ndarray, left: np.ndarray, group: np.ndarray, known: np.ndarray, width: int) -> np.ndarray:
    """(piece, offset) of each LENGTH-byte string that also stands in another piece of its group, or in a known one.

    The pieces are distinct; piece i is ``left[i]`` bytes, its group's core and
    the rest of its bytes.  The core is the same throughout a group, so it is
    one symbol here, and a string is ``width`` symbols.
    """
    around = np.diff(offsets)
    sizes = around + 2
    first = np.cumsum(sizes) - sizes
    s = np.ones(sizes.sum() + 1, np.int64)  # 1 ends a piece
    s[-1] = 0
    s[first + left] = 2
    piece = np.repeat(np.arange(len(left)), around)
    within = np.arange(len(piece)) - offsets[piece]
    s[first[piece] + within + (within >= left[piece])] = data.astype(np.int64) + 3
    sa = suffix_array(s, 259)
    shared = np.cumsum(common_prefixes(s, sa, width)[sa] < width)  # suffixes that begin with the same ``width`` symbols
    piece = np.searchsorted(first, sa, side="right") - 1
    offset = sa - first[piece]
    whole = np.flatnonzero(offset + width < sizes[piece])
    piece, offset, shared = piece[whole], offset[whole], shared[whole]
    order = np.lexsort((shared, group[piece]))
    piece, offset, shared = piece[order], offset[order], shared[order]
    if not len(piece):
        return np.zeros((0, 2), np.int64)
    new = np.concatenate(([True], (shared[1:] != shared[:-1]) | (group[piece][1:] != group[piece][:-1])))
    cuts = np.flatnonzero(new)
    # a piece holds one string at each offset of the core, so equal strings stand in different pieces or at different offsets
    many = np.diff(np.append(cuts, len(piece))) > 1
    many |= np.maximum.reduceat(known[piece], cuts)
    found = np.flatnonzero(many[np.cumsum(new) - 1])
    return np.stack([piece[found], offset[found]], axis=1)


def runs(of: np.ndarray, offset: np.ndarray):
    """Maximal covered runs (piece, first, end) of strings that begin at (of, offset)."""
    order = np.lexsort((offset, of))
    of, offset = of[order], offset[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (offset[1:] > offset[:-1] + LENGTH)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(of)) - 1
    return (of[a], offset[a], offset[b] + LENGTH) if len(of) else (of, of, of)


INTERVAL = "key binary, first long, end long"


def by_arrays(groups: DataFrame, width: int) -> DataFrame:
    """Covered intervals of the pieces of ``groups``, but for known ones, compared within suffix arrays of whole groups."""
    around = width - 1  # bytes of a string outside the core

    def done(held: list[pa.Table]):
        t = pa.concat_tables(held).combine_chunks()
        keys, start = t.column("key"), t.column("start").to_numpy()
        left, known = t.column("left").to_numpy().astype(np.int64), t.column("known").to_numpy()
        data, offsets = text_bytes(t.column("around").cast(pa.large_binary()))
        # equal pieces are repeated throughout; one of them is compared with the others
        _, group = np.unique(t.column("group").to_numpy(), return_inverse=True)
        same = mix(span_hashes(prefix_hashes(data), offsets[:-1], offsets[1:]) + group.astype(np.uint64) * _LEFT + left.astype(np.uint64) * _RIGHT)
        _, one, kind, n = np.unique(same, return_index=True, return_inverse=True, return_counts=True)
        whole = (n > 1) | (np.bincount(kind, known) > 0)
        copies = np.flatnonzero(whole[kind] & ~known)
        out = [(copies, start[copies], start[copies] + np.diff(offsets)[copies] + LENGTH - around)]
        kinds_of, single = np.bincount(group[one]), np.bincount(group[one], ~whole)
        one, whole = (x[(kinds_of > 1)[group[one]] & (single > 0)[group[one]]] for x in (one, whole))
        if len(one):
            size = np.diff(offsets)[one]
            ends = np.concatenate(([0], np.cumsum(size)))
            at = np.repeat(offsets[one] - ends[:-1], size) + np.arange(ends[-1])
            found = repeated(data[at], ends, left[one], group[one], whole, width)
            found = found[~whole[found[:, 0]]]
            of, a, b = runs(found[:, 0], found[:, 1])
            out.append((one[of], start[one[of]] + a, start[one[of]] + b))
        rows, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.record_batch([keys.take(pa.array(rows)).combine_chunks(), pa.array(a), pa.array(b)], names=["key", "first", "end"])

    def compare(batches):
        held, size = [], 0
        for t in by_key(batches, 1):
            if held and size + (2 * around + 2) * len(t) > ARRAY_SYMBOLS:
                yield done(held)
                held, size = [], 0
            held.append(t)
            size += (2 * around + 2) * len(t)
        if held:
            yield done(held)

    return groups.select(PIECE).repartition("group").sortWithinPartitions("group").mapInArrow(compare, INTERVAL)


def by_parts(pieces: DataFrame, level: int = 0) -> DataFrame:
    """Covered intervals of ``pieces`` in large groups, but for known ones: equal pieces as a whole, the other distinct ones
    by suffix arrays, after they have been cut finer where a group has too many."""
    spark, width = pieces.sparkSession, WIDTHS[level]
    if width == 1:  # a group holds one string
        many = pieces.groupBy("group").agg(((F.count("*") > 1) | F.max("known")).alias("many")).where("many").select(F.col("group").alias("_group"))
        found = pieces.where("not known").select("group", "key", F.col("start").alias("first")).join(many, F.col("group") == F.col("_group"), "left_semi")
        return found.select("key", "first", (F.col("first") + LENGTH).alias("end"))
    kind = ["group", "left", "around"]
    kinds_of = pieces.groupBy(kind).agg((F.count("*") > 1) | F.max("known"), F.min(F.struct("key", "start"))).toDF(*kind, "known", "one")
    kinds_of = stage(spark, kinds_of.select("group", "one.key", "one.start", "left", "around", "known"), "repeat-kinds")
    copies = kinds_of.where("known").select(*(F.col(c).alias(f"_{c}") for c in kind))
    same = (F.col("group") == F.col("_group")) & (F.col("left") == F.col("_left")) & (F.col("around") == F.col("_around"))
    found = pieces.where("not known").join(copies, same, "left_semi").select("key", F.col("start").alias("first"), (F.col("start") + F.length("around") + LENGTH - width + 1).alias("end"))
    sizes = kinds_of.groupBy("group").agg(F.count("*").alias("size"), F.min(F.col("known").cast("int")).alias("known"))
    sizes = stage(spark, sizes.where("size > 1 and known = 0").select(F.col("group").alias("_group"), "size"), "repeat-groups")
    return found.union(compare_groups(kinds_of, sizes, level, level + 1))


def compare_groups(pieces: DataFrame, sizes: DataFrame, level: int, finer: int) -> DataFrame:
    """Covered intervals of ``pieces`` in the groups of ``sizes``; those of large groups are cut to the width of ``finer`` first."""
    compared = pieces.join(broadcast_if_small(sizes, 24), F.col("group") == F.col("_group"))
    found = by_arrays(compared.where(F.col("size") <= MOST_SEGMENTS), WIDTHS[level])
    if sizes.where(F.col("size") > MOST_SEGMENTS).isEmpty():
        return found
    large = compared.where(F.col("size") > MOST_SEGMENTS).select(PIECE)
    if finer > level:
        large = stage(pieces.sparkSession, cut_finer(large, WIDTHS[level], WIDTHS[finer]), "finer-pieces")
    return found.union(by_parts(large, finer))


def covered(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """(key, first, end) of byte intervals whose every byte is covered by a repeated string; they may overlap."""
    spots = stage(spark, occurrences(texts), "anchors")
    segments = stage(spark, spots.groupBy("anchor", "segment").agg(F.count("*").alias("n")), "segments")
    mixed = segments.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("single"))
    mixed = mixed.where("kinds > 1 and single > 0").select(F.col("anchor").alias("_of"))
    wanted = segments.join(mixed, F.col("anchor") == F.col("_of"), "left").where("n > 1 or _of is not null")
    wanted = wanted.select(F.col("anchor").alias("_anchor"), F.col("segment").alias("_segment"), (F.col("n") > 1).alias("known"), F.col("_of").isNotNull().alias("mixed"))
    # places are moved once, and kept only where a segment is repeated or has others around its anchor
    places = spots.join(wanted, (F.col("anchor") == F.col("_anchor")) & (F.col("segment") == F.col("_segment"))).select("key", "pos", "anchor", "segment", "known", "mixed")
    places = stage(spark, places, "places")
    full = places.where("known").select("key", "pos")  # equal segments: everything in them is repeated
    # different segments around one anchor: the distinct ones are compared
    members = places.where("mixed").groupBy("anchor", "segment", "known").agg(F.min(F.struct("key", "pos")).alias("one"))
    members = members.select(F.col("one.key").alias("_key"), F.struct(F.col("one.pos").alias("pos"), "known").alias("spot"))
    members = members.groupBy("_key").agg(F.collect_list("spot").alias("spots"))  # at most a text's own anchors
    members = stage(spark, members, "members")
    keys = broadcast_if_small(stage(spark, members.select(F.col("_key").alias("_of")), "member-keys"), 48)
    once = texts.join(keys, F.col("key") == F.col("_of"), "left_semi")  # only texts with segments to compare are moved
    once = stage(spark, once.join(members, F.col("key") == F.col("_key")).dropDuplicates(["key"]).select("key", "text", "spots"), "member-texts")
    # only groups with several segments, some of them not known to be repeated, are compared
    pieces = stage(spark, cut_out(once), "pieces")
    sizes = pieces.groupBy("group").agg(F.count("*").alias("size"), F.min(F.col("known").cast("int")).alias("known"))
    sizes = stage(spark, sizes.where("size > 1 and known = 0").select(F.col("group").alias("_group"), "size"), "groups")
    found = compare_groups(pieces, sizes, 0, 0)  # equal pieces of large groups are brought together before any is cut finer
    whole = full.select("key", F.greatest(F.col("pos") - REACH, F.lit(0)).alias("first"), (F.col("pos") + LENGTH).alias("end"))  # the end is cut to the text later
    return whole.union(found)


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every row."""
    with scratch(spark) as keep:
        gone = covered(spark, docs.select(key_of(text_of()).alias("key"), text_of().alias("text")))
        gone = keep(gone.groupBy(F.col("key").alias("_key")).agg(F.collect_set(F.struct("first", "end")).alias("gone")), "covered")
    keys = broadcast_if_small(keep(gone.select(F.col("_key").alias("_of")), "covered-keys"), 48)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), key_of(text_of()).alias("key"))
    cut_texts = rows.join(keys, F.col("key") == F.col("_of"), "left_semi").join(gone, F.col("key") == F.col("_key"))  # only texts that lose something are moved
    whole_texts = rows.join(keys, F.col("key") == F.col("_of"), "left_anti").withColumn("gone", F.lit(None).cast(gone.schema["gone"].dataType))
    rows = cut_texts.select("doc_id", "text", "gone").unionByName(whole_texts.select("doc_id", "text", "gone"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def cut(batches):
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.slice(lo, 1000)
                data, offsets = text_bytes(part.column(1))
                out = []
                for r, gone in enumerate(part.column(2).to_pylist()):
                    raw, spans = data[offsets[r]:offsets[r + 1]], 0
                    if gone:
                        edge = np.zeros(len(raw) + 1, np.int64)
                        np.add.at(edge, [g["first"] for g in gone], 1)
                        np.add.at(edge, [min(len(raw), g["end"]) for g in gone], -1)
                        hidden = np.cumsum(edge)[:-1] > 0
                        spans = int(hidden[0]) + int((hidden[1:] & ~hidden[:-1]).sum())
                        kept = raw[~hidden].tobytes()
                    else:
                        kept = raw.tobytes()
                    out.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
                cols = list(zip(*out, strict=True))
                yield pa.record_batch([part.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))],
                                      names=[f.split()[0] for f in schema.split(", ")])

    return rows.mapInArrow(cut, schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, table(spark, sf_dir, "documents")).drop("kept")
