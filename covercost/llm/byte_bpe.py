"""Operator 9: byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

Each partition splits its texts into pretokens and encodes every distinct one
once: token-position rows join the merge table, and each word's leftmost pair
of the least rank is contracted, round by round, until no pair merges.  Decoding
joins the positions to the vocabulary and concatenates in order.  A text's ids
and bytes are those of its pretokens in order.

A word of up to LONG bytes runs in one recursive query.  Longer ones run the
same step on a table that is replaced each round; there a round contracts all
occurrences of the word's least pair at once when no pair that this makes has
a lower rank, else only the leftmost one, so the ids are the same.

Defined cases: null text is the empty text (no ids, no bytes); no special
tokens; repeated rows give repeated results; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covercost.llm.base import powers, mix, slices, stream, table, text_bytes

#: Longest word, in bytes, that the single recursive query takes.
LONG = 64
#: Distinct words that one query takes, and that a Python worker remembers between batches.
CHUNK, REMEMBERED = 8_000, 150_000
#: Text bytes of the rows whose words are encoded together.
BATCH_BYTES = 1 << 20
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: The suffixes that the pattern splits off after a single apostrophe.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_BASE = 0xD1B54A32D192ED03
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


@cache
def code_point_classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of each code point."""
    import regex

    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000))
    out = np.full(len(every), OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[m.start():m.end()] = kind
    out[WHITE_SPACE] = SPACE
    return out


def pretokens(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where each match of the pretoken pattern begins, in the code points of texts that begin at ``offsets``."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = code_point_classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = edge[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    ends_run = np.append(begin[1:], True)
    last_space = (kind == SPACE) & ends_run & ~edge[1:]  # of a run with more text behind it
    blank = last_space & (points == 32)
    begin |= last_space  # the run before it is a token of its own
    after = np.flatnonzero(blank) + 1
    begin[after] = False  # a blank belongs to what follows
    # 's, 't, ... after an apostrophe that stands alone and has no blank before it
    lone = np.flatnonzero((points == 39) & begin & ends_run)
    if len(lone):
        padded = np.append(points, [0, 0])
        text_end = offsets[np.searchsorted(offsets, lone, side="right")]
        taken = np.zeros(len(lone), np.int64)
        for s in SUFFIXES:
            fits = (taken == 0) & (lone + len(s) < text_end)
            for k, ch in enumerate(s):
                fits &= padded[np.minimum(lone + 1 + k, n)] == ord(ch)
            taken[fits] = len(s)
        at, taken = lone[taken > 0], taken[taken > 0]
        begin[at + 1] = False
        nxt = at + 1 + taken
        inside = nxt < n
        # letters behind the suffix make a token; anything else begins one already
        begin[nxt[inside]] |= (kind[nxt[inside]] == LETTER)
    return np.flatnonzero(begin)


def vocabulary(path: str | None = None) -> dict[bytes, int]:
    """Token bytes and their ranks, from a tiktoken file (default: the public byte-level 50k vocabulary)."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _leftmost(source: str) -> str:
    """SQL of one round: the words of ``source`` (word, it, pos, tok; pos from 0 without gaps) that have a pair
    to merge, their leftmost pair of the least rank contracted."""
    return f"""
      with least as (  -- rank of the pair, then its position, in one number
        select a.word, min((m.id::bigint << 32) | a.pos) as pair
        from {source} a join {source} b on b.word = a.word and b.pos = a.pos + 1 join merges m on m.l = a.tok and m.r = b.tok group by a.word)
      select s.word, s.it + 1 as it, (case when s.pos > (pair & 4294967295) then s.pos - 1 else s.pos end)::int as pos,
             case when s.pos = (pair & 4294967295) then (pair >> 32)::int else s.tok end as tok
      from {source} s join least using (word) where s.pos <> (pair & 4294967295) + 1"""


def _every(source: str) -> str:
    """The same with all occurrences of the word's least pair contracted; of overlapping ones every other, from the left."""
    return f"""
      select word, it + 1 as it, (row_number() over (partition by word order by pos) - 1)::int as pos, case when hit then best else tok end as tok
      from (select *, lag(hit) over (partition by word order by pos) as gone
            from (select *, id = best and run is not null and row_number() over (partition by word, run order by pos) % 2 = 1 as hit
                  from (select *, case when id = best then pos - row_number() over (partition by word, id = best order by pos) end as run
                        from (select *, min(id) over (partition by word) as best
                              from (select p.*, m.id from (select *, lead(tok) over (partition by word order by pos) as nxt from {source}) p
                                    left join merges m on m.l = p.tok and m.r = p.nxt)))))
      where best is not null and not coalesce(gone, false)"""


RECURSIVE = f"""
  with recursive rounds(word, it, pos, tok) as (
    select word, 0, pos, tok from start
    union all
    ({_leftmost('rounds')})),
  final as (select word, max(it) as it from rounds group by word)
  select word, pos, tok from rounds join final using (word, it)"""
ENCODED = """
  select word, string_agg(cast(tok as varchar), ' ' order by pos) as ids, string_agg(v.hex, '' order by pos) as hex
  from done join vocab v on v.id = done.tok group by word"""


class Coder:
    """The merge table and vocabulary, a DuckDB connection that holds them while a task runs, and the words encoded last."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, ids = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), ids.append(rank)
        vocab = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "hex": [t.hex() for t in ranks]})
        merges = pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "id": pa.array(ids, pa.int32())})
        self.tables = {"vocab": vocab, "merges": merges}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[int, bytes] = {}
        self.db: duckdb.DuckDBPyConnection | None = None
        self.open()

    def open(self) -> None:
        if self.db is None:
            self.db = duckdb.connect()
            self.db.execute("set threads = 1")
            self.db.execute("set memory_limit = '256MB'")
            self.db.execute("set enable_progress_bar = false")
            for name, t in self.tables.items():
                self.db.register("_t", t)
                self.db.execute(f"create table {name} as select * from _t")
                self.db.unregister("_t")

    def rest(self) -> None:
        """Give back what only a running task needs: the worker stays, and shares its executor's memory with later stages."""
        if self.db is not None:
            self.db.close()
            self.db = None
        pa.default_memory_pool().release_unused()

    def _start(self, words: list[bytes]) -> pa.Table:
        sizes = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(words), np.uint8)
        return pa.table({"word": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "it": np.zeros(len(raw), np.int32),
                         "pos": (np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32), "tok": self.of_byte[raw]})

    def _long(self) -> None:
        """Contract the words of table ``start`` until nothing merges; the tokens are in table ``done`` then."""
        db = self.db
        db.execute("create or replace temp table live as select * from start")
        db.execute("create or replace temp table done as select word, pos, tok from start limit 0")
        while db.execute("select count(*) from live").fetchall()[0][0]:
            db.execute(f"create or replace temp table every as {_every('live')}")
            db.execute("insert into done select word, pos, tok from live where word not in (select word from every)")
            # contracting all at once is the same unless it makes a pair of lower rank on the way
            db.execute(f"""
              create or replace temp table hasty as
              with best as (select word, min(m.id) as best from (select word, tok, lead(tok) over (partition by word order by pos) as nxt from live) p
                            join merges m on m.l = p.tok and m.r = p.nxt group by word),
              made as (select word, min(m.id) as least from (select word, tok, lead(tok) over (partition by word order by pos) as nxt from every) p
                       join merges m on m.l = p.tok and m.r = p.nxt group by word),
              beside as (select b.word, min(x.id) as least from best b join merges m on m.id = b.best join merges x on x.l = b.best and x.r = m.l group by b.word)
              select best.word from best left join made using (word) left join beside using (word)
              where made.least < best.best or beside.least < best.best""")
            db.execute("create or replace temp table slow as select * from live where word in (select word from hasty)")
            db.execute(f"create or replace temp table live as select * from every where word not in (select word from hasty) union all ({_leftmost('slow')})")

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Of each distinct non-empty word the ids as text, each with a blank behind it, a zero byte, and the decoded bytes."""
        out: list = [None] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= LONG]
        rest = [k for k, w in enumerate(words) if len(w) > LONG]
        parts = [short[a:a + CHUNK] for a in range(0, len(short), CHUNK)]
        while rest:  # at most CHUNK * LONG bytes at once, or one word
            size, n = 0, 0
            while n < len(rest) and (n == 0 or size + len(words[rest[n]]) <= CHUNK * LONG):
                size, n = size + len(words[rest[n]]), n + 1
            parts, rest = [*parts, rest[:n]], rest[n:]
        for part in parts:
            self.db.register("start", self._start([words[k] for k in part]))
            if len(words[part[0]]) <= LONG:
                got = self.db.sql(f"with done as materialized ({RECURSIVE}) {ENCODED}").to_arrow_table()
            else:
                self._long()
                got = self.db.sql(ENCODED).to_arrow_table()
            self.db.unregister("start")
            for w, ids, raw in zip(*(got.column(c).to_pylist() for c in ("word", "ids", "hex")), strict=True):
                out[part[w]] = ids.encode() + b" \0" + bytes.fromhex(raw)
        return out

    def texts(self, texts: pa.Array):
        """(number of ids, ids joined by blanks, decoded bytes; both as uint8 arrays) of each text, in order."""
        data, offsets = text_bytes(texts)
        held = []
        for lo, hi in slices(offsets):
            own = offsets[lo:hi + 1] - offsets[lo]
            raw = data[offsets[lo]:offsets[hi]]
            points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
            first = np.flatnonzero((raw & 0xC0) != 0x80)  # first byte of each code point
            begins = pretokens(points, np.searchsorted(first, own))
            at = first[begins] if len(begins) else np.zeros(0, np.int64)
            ends = np.append(at[1:], len(raw))[:len(at)]
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_VALUES[raw] * powers(_BASE, len(raw)), out=sums[1:])
            keys = mix((sums[ends] - sums[at]) * powers(_BASE_INVERSE, len(raw) + 1)[at])
            distinct, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
            held.append((distinct, at[where] + offsets[lo], ends[where] + offsets[lo], inverse.astype(np.int32), np.searchsorted(at, own)))
        if not held:
            return
        keys, where, place = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
        at, ends = (np.concatenate([h[k] for h in held])[where].tolist() for k in (1, 2))
        names = keys.tolist()
        missing = {x: data[a:b].tobytes() for x, a, b in zip(names, at, ends, strict=True) if x not in self.known}
        fresh = dict(zip(missing, self.encode(list(missing.values())), strict=True))
        known = [fresh[x] if x in fresh else self.known[x] for x in names]
        parts = [k.partition(b"\0") for k in known]
        all_ids, all_raw = pa.array([k[0] for k in parts], pa.large_binary()), pa.array([k[2] for k in parts], pa.large_binary())
        del parts
        sizes = pc.count_substring(all_ids, b" ").to_numpy()
        done = 0
        for distinct, _, _, inverse, bounds in held:
            which = place[done:done + len(distinct)][inverse]
            done += len(distinct)
            ids, ids_at = text_bytes(all_ids.take(pa.array(which)))
            raw, raw_at = text_bytes(all_raw.take(pa.array(which)))
            total = np.concatenate(([0], np.cumsum(sizes[which])))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                yield int(total[b] - total[a]), ids[ids_at[a]:max(ids_at[a], ids_at[b] - 1)], raw[raw_at[a]:raw_at[b]]
        self.known |= fresh
        if len(self.known) > REMEMBERED:
            self.known = dict(zip(names, known, strict=True)) if len(names) <= REMEMBERED else {}


_VALUES = stream(91, 256)
_coders: dict[int, Coder] = {}


def coder(ranks: dict[bytes, int]) -> Coder:
    """This Python worker's coder for the vocabulary."""
    key = hash(frozenset(ranks.items()))
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(ranks)
    _coders[key].open()
    return _coders[key]


def encode_decode(spark: SparkSession, docs: DataFrame, path: str | None = None, ids: bool = False, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with ``ids`` the ids (array), with ``decoded`` the decoded bytes as well."""
    shared = spark.sparkContext.broadcast(vocabulary(path))  # a vocabulary file: some ten thousand short entries
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded binary" * decoded

    def code(batches):
        own = None
        try:
            for batch in batches:
                own = own or coder(shared.value)
                for lo, hi in slices(text_bytes(batch.column(1))[1], BATCH_BYTES):
                    part = batch.slice(lo, hi - lo)
                    rows, coded, raw = [], [], []
                    for n, i, d in own.texts(part.column(1)):
                        rows.append((n, hashlib.sha256(i).hexdigest(), hashlib.sha256(d).hexdigest()))
                        if ids:
                            coded.append(np.fromstring(i.tobytes(), np.int32, sep=" "))
                        if decoded:
                            raw.append(d.tobytes())
                    cols = [part.column(0).cast(pa.int64()), pa.array([n for n, _, _ in rows], pa.int64()),
                            pa.array([i for _, i, _ in rows], pa.string()), pa.array([d for _, _, d in rows], pa.string())]
                    if ids:  # one flat array, cut by its offsets
                        ends = np.concatenate(([0], np.cumsum([n for n, _, _ in rows])))
                        cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*coded, np.zeros(0, np.int32)]))))
                    if decoded:
                        cols.append(pa.array(raw, pa.binary()))
                    yield pa.record_batch(cols, names=[f.split()[0] for f in schema.split(", ")])
                    del part, rows, coded, raw, cols
                    pa.default_memory_pool().release_unused()
        finally:
            if own:
                own.rest()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(code, schema)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark, table(spark, sf_dir, "documents"))
