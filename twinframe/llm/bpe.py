"""Byte-level BPE by recursive queries of an in-process DuckDB, one for each Python worker.

A word (a match of the splitting pattern) is a set of rows (word, position, token). A recursive
query joins neighbouring rows with the merge table, takes the leftmost pair of least rank of every
word, contracts it and goes on with the words that had one, until none has. Texts are put together
from the tokens of their words. Decoding joins the tokens with the vocabulary and gathers their
bytes by an ordered aggregation.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Bytes of text, or characters of a longer one, and tokens worked on at a time: what numpy and DuckDB hold.
CHARS = 1 << 19
TOKENS = 1 << 17
#: Words of one recursive query, and the longest word, in bytes, of which one pair is contracted a step.
WORDS = 20_000
SHORT = 64
#: Rows and steps of a query over longer words; what is unfinished then starts the next query.
LONG_ROWS = 1 << 21
STEPS = 64
#: Words whose tokens a worker remembers; then it starts anew. Affects time only.
REMEMBERED = 600_000

# The pattern whose matches `cut_words` finds, and the endings that follow an apostrophe.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

_EDGE, _LETTER, _NUMBER, _BLANK, _OTHER = range(5)


def ranks_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where this machine keeps the rank file; every executor looks for itself."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache
def _classes() -> np.ndarray:
    """The class of every code point; the one past the last marks the edge of a text."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    found = np.full(0x110001, _OTHER, dtype=np.int8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, r"\s+")):
        for match in regex.finditer(pattern, every):
            points = np.frombuffer(match[0].encode("utf-32-le"), dtype="<u4")
            found[points] = kind
    found[0x110000] = _EDGE
    return found


def cut_words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """(all matches of PATTERN in the texts as binary, how many each text has), by character classes.

    A match starts where the class changes. A space in front of a letter, number or other character
    belongs to what follows it; the last of several blanks stands alone before such a character; an
    apostrophe alone takes the ending that follows it.
    """
    edge = np.array([0x110000], dtype="<u4")
    points = np.concatenate([x for t in texts for x in (np.frombuffer(t.encode("utf-32-le"), dtype="<u4"), edge)])
    kind = _classes()[points]
    start = np.ones(len(points), dtype=bool)
    start[1:] = kind[1:] != kind[:-1]
    blank_before = np.zeros(len(points), dtype=bool)
    blank_before[1:] = kind[:-1] == _BLANK
    ahead = np.flatnonzero(start & blank_before & (kind != _EDGE))
    start[ahead - 1] = True
    start[ahead[points[ahead - 1] == 0x20]] = False
    # An apostrophe that is a match of its own, before letters.
    alone = np.flatnonzero(start[:-1] & (points[:-1] == 0x27) & (kind[1:] == _LETTER))
    for ending in ENDINGS:
        at = alone[alone + len(ending) < len(points)]
        for k, letter in enumerate(ending):
            at = at[points[at + 1 + k] == ord(letter)]
        start[at + 1] = False
        start[at + 1 + len(ending)] = True
    width = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))
    width[kind == _EDGE] = 0
    places = np.cumsum(width) - width
    data = "".join(texts).encode()
    inner = start & (kind != _EDGE)
    offsets = np.append(places[inner], len(data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    ends = np.flatnonzero(kind == _EDGE)
    counts = np.diff(np.concatenate([[0], np.cumsum(inner)[ends]]))
    return words, counts


_SHORT_SQL = f"""
WITH RECURSIVE steps(word, pos, id, step) AS (
  SELECT word, pos, id, 0 FROM seed
  UNION ALL
  (WITH best AS (
     SELECT a.word, min(m.rank * {SHORT} + a.pos) AS best
     FROM steps a JOIN steps b ON b.word = a.word AND b.pos = a.pos + 1 JOIN merges m ON m.a = a.id AND m.b = b.id
     GROUP BY a.word
   )
   SELECT word, pos - (pos > best % {SHORT})::INT, CASE WHEN pos = best % {SHORT} THEN (best // {SHORT})::INT ELSE id END, step + 1
   FROM steps JOIN best USING (word) WHERE pos <> best % {SHORT} + 1)
)
SELECT word, id FROM steps JOIN (SELECT word, max(step) AS step FROM steps GROUP BY word) USING (word, step) ORDER BY word, pos
"""

# Equal pairs of a word that follow one another count from the left, every second one is contracted.
_LONG_SQL = """
WITH RECURSIVE steps(word, pos, id, step) AS (
  SELECT word, pos, id, 0 FROM seed
  UNION ALL
  (WITH pairs AS (
     SELECT n.word, n.pos, n.after, m.rank, m.together
     FROM (SELECT word, pos, id, lead(id) OVER w AS next, lead(pos) OVER w AS after FROM steps WINDOW w AS (PARTITION BY word ORDER BY pos)) n
     JOIN merges m ON m.a = n.id AND m.b = n.next
   ), least AS (
     SELECT p.*, row_number() OVER w AS n, coalesce(lag(after) OVER w <> pos, true) AS fresh
     FROM pairs p JOIN (SELECT word, min(rank) AS rank FROM pairs GROUP BY word) USING (word, rank)
     WINDOW w AS (PARTITION BY word ORDER BY pos)
   ), runs AS (
     SELECT *, n - max(CASE WHEN fresh THEN n END) OVER (PARTITION BY word ORDER BY pos) AS place FROM least
   ), chosen AS (
     SELECT word, pos, after, rank FROM runs WHERE CASE WHEN together THEN place % 2 = 0 ELSE n = 1 END
   )
   SELECT s.word, s.pos, coalesce(c.rank, s.id)::INT, s.step + 1
   FROM steps s SEMI JOIN chosen ON chosen.word = s.word
     LEFT JOIN chosen c ON c.word = s.word AND c.pos = s.pos
     ANTI JOIN chosen d ON d.word = s.word AND d.after = s.pos
   WHERE s.step < {steps})
)
SELECT word, pos, id, step FROM steps JOIN (SELECT word, max(step) AS step FROM steps GROUP BY word) USING (word, step) ORDER BY word, pos
"""

_DECODE_SQL = "SELECT part, list(bytes ORDER BY pos) AS bytes FROM tokens JOIN vocabulary USING (id) GROUP BY part ORDER BY part"


class Coder:
    """Vocabulary and merges of a rank file in DuckDB, and the tokens of the words seen lately."""

    def __init__(self, path: str):
        lines = open(path, "rb").read().splitlines()
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.known = np.zeros(max(self.ranks.values()) + 1, dtype=bool)
        self.known[list(self.ranks.values())] = True
        pairs = [
            (self.ranks[token[:k]], self.ranks[token[k:]], rank)
            for token, rank in self.ranks.items()
            for k in range(1, len(token))
            if token[:k] in self.ranks and token[k:] in self.ranks
        ]
        a, b, rank = np.array(pairs, dtype=np.int64).reshape(-1, 3).T
        # A pair may be contracted all over a word at once if no pair with the new token comes before it.
        early = np.zeros(len(self.known), dtype=bool)
        early[a[a > rank]] = True
        early[b[b > rank]] = True
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": "", "autoinstall_known_extensions": False})
        self._table("merges", {"a": a, "b": b, "rank": rank, "together": ~early[rank]})
        self._table("vocabulary", {"id": np.array(list(self.ranks.values()), dtype=np.int32), "bytes": pa.array(list(self.ranks), pa.binary())})
        self._forget()

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS FROM given")
        self.db.unregister("given")

    def _query(self, sql: str, name: str, columns: dict) -> pa.Table:
        self.db.register(name, pa.table(columns))
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.sizes, self.tokens = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def _seed(self, words: list[bytes]) -> dict:
        lengths = np.array([len(w) for w in words])
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        return {
            "word": np.repeat(np.arange(len(words), dtype=np.int32), lengths),
            "pos": (np.arange(len(flat)) - np.repeat(starts, lengths)).astype(np.int32),
            "id": self.bytes[flat],
        }

    def _short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self._query(_SHORT_SQL, "seed", self._seed(words))
        return np.bincount(found["word"].to_numpy(), minlength=len(words)), found["id"].to_numpy()

    def _long(self, word: bytes) -> np.ndarray:
        state, step = self._seed([word]), None
        while step is None or step == steps:
            steps = max(1, min(STEPS, LONG_ROWS // len(state["id"])))
            found = self._query(_LONG_SQL.format(steps=steps), "seed", state)
            state = {c: found[c].to_numpy() for c in ("word", "pos", "id")}
            step = found["step"][0].as_py()
        return state["id"]

    def learn(self, words: list[bytes]) -> None:
        """Tokens of new words: a word of the vocabulary is its own token, the others are merged."""
        sizes, tokens, names = [], [], []
        whole = [w for w in words if w in self.ranks]
        if whole:
            names, sizes = list(whole), [np.ones(len(whole), dtype=np.int64)]
            tokens = [np.array([self.ranks[w] for w in whole], dtype=np.int32)]
        short = [w for w in words if w not in self.ranks and len(w) <= SHORT]
        for at in range(0, len(short), WORDS):
            part = short[at : at + WORDS]
            n, ids = self._short(part)
            names, sizes, tokens = names + part, [*sizes, n], [*tokens, ids]
        for word in words:
            if len(word) > SHORT and word not in self.ranks:
                ids = self._long(word)
                names, sizes, tokens = [*names, word], [*sizes, np.array([len(ids)])], [*tokens, ids]
        self.place.update(zip(names, range(len(self.place), len(self.place) + len(names))))
        self.sizes = np.concatenate([self.sizes, *sizes])
        self.tokens = np.concatenate([self.tokens, *tokens])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        words, counts = cut_words(texts)
        coded = words.dictionary_encode()
        different = coded.dictionary.to_pylist()
        if len(self.place) + len(different) > REMEMBERED:
            self._forget()
        new = [w for w in different if w not in self.place]
        if new:
            self.learn(new)
        at = np.array([self.place[w] for w in different], dtype=np.int64)[coded.indices.to_numpy()]
        starts, sizes = (np.cumsum(self.sizes) - self.sizes)[at], self.sizes[at]
        before = np.cumsum(sizes) - sizes
        ids = self.tokens[np.arange(sizes.sum()) + np.repeat(starts - before, sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
        return np.split(ids, ends[:-1])

    def decode(self, parts: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of known ids."""
        sizes = np.array([len(p) for p in parts])
        ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
        columns = {"part": np.repeat(np.arange(len(parts), dtype=np.int32), sizes), "pos": np.arange(len(ids), dtype=np.int32), "id": ids}
        found = self._query(_DECODE_SQL, "tokens", columns)
        out, at = [b""] * len(parts), 0
        part = found["part"].to_numpy()
        for lists in found["bytes"].chunks:
            flat = lists.flatten().cast(pa.binary())
            # The bytes of all tokens lie one after the other in the order of the aggregation.
            ends = np.frombuffer(flat.buffers()[1], dtype=np.int32)[flat.offset : flat.offset + len(flat) + 1]
            bounds = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            for k, row in enumerate(part[at : at + len(lists)].tolist()):
                out[row] = flat.buffers()[2].slice(bounds[k], bounds[k + 1] - bounds[k]).to_pybytes()
            at += len(lists)
        return out


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


_BOUNDARY = regex.compile(r"(?<=\S)\s")


def slices(text: str, size: int = CHARS) -> Iterator[str]:
    """The text cut before blanks that follow other characters, where every match ends anyway."""
    at = 0
    while len(text) - at > size:
        match = _BOUNDARY.search(text, at + size)
        if not match:
            break
        yield text[at : match.start()]
        at = match.start()
    yield text[at:]


def _spans(sizes: list[int], most: int) -> Iterator[slice]:
    """Consecutive items of at most `most` in all, or a larger one alone."""
    at = 0
    while at < len(sizes):
        end, total = at + 1, sizes[at]
        while end < len(sizes) and total + sizes[end] <= most:
            total += sizes[end]
            end += 1
        yield slice(at, end)
        at = end


def _encoded(own: Coder, texts: list[str]) -> list[np.ndarray]:
    if len(texts) == 1:
        return [np.concatenate([own.encode([s])[0] for s in slices(texts[0])])]
    return own.encode(texts)


def _decoded(own: Coder, rows: list[np.ndarray | None]) -> list[bytes | None]:
    good = [i is not None and bool((i < len(own.known)).all() and own.known[i].all()) for i in rows]
    parts = [(row, i[at : at + TOKENS].astype(np.int32)) for row, i in enumerate(rows) if good[row] for at in range(0, len(i), TOKENS)]
    out: list[list[bytes]] = [[] for _ in rows]
    for span in _spans([len(p) for _, p in parts], TOKENS):
        for (row, _), data in zip(parts[span], own.decode([p for _, p in parts[span]])):
            out[row].append(data)
    return [b"".join(o) if g else None for o, g in zip(out, good)]


def encode(
    docs: DataFrame, path: str | None = None, text_col: str = "text", id_col: str = "doc_id", with_decoded: bool = False
) -> DataFrame:
    """(id, n_tokens, tokens) of every row; `tokens` holds the ids as little-endian unsigned 32-bit integers.

    Null texts count as empty and have no tokens. Every match of PATTERN is merged for itself, by
    the ranks of the file at `path`, without special tokens; their strings are ordinary text.
    Repeated rows and null ids come back as they are. A text of any length is read in slices cut
    where matches end, and no slice is longer than CHARS but for a run without such a place.
    `with_decoded` adds what `decode` gives for the tokens, without a second pass of Python workers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path or ranks_path())
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()
            for span in _spans(sizes, CHARS):
                rows = batch.slice(span.start, span.stop - span.start)
                found = _encoded(own, [t or "" for t in rows.column(1).to_pylist()])
                columns = {
                    "id": rows.column(0),
                    "n_tokens": pa.array([len(f) for f in found], pa.int64()),
                    "tokens": pa.array([f.astype("<u4").tobytes() for f in found], pa.binary()),
                }
                if with_decoded:
                    columns["decoded"] = pa.array(_decoded(own, found), pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"id {dict(docs.dtypes)[id_col]}, n_tokens long, tokens binary" + (", decoded binary" if with_decoded else "")
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of `encode` with `decoded`, the bytes that the ids stand for.

    Null tokens and tokens that hold an id the file does not know give null. Rows longer than TOKENS
    are decoded in slices.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path or ranks_path())
        for batch in batches:
            ids = [None if t is None else np.frombuffer(t, dtype="<u4").astype(np.int64) for t in batch["tokens"].to_pylist()]
            decoded = pa.array(_decoded(own, ids), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, "decoded"])

    return coded.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in coded.dtypes) + ", decoded binary")
