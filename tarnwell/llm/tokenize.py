"""Encoding of the whole corpus with a public byte-level BPE tokenizer.

Texts are cut into words by the tokenizer's pattern. Words not seen before by a worker are encoded by a recursive DuckDB
query: rows (word, position, token) are joined with the merge table, and in each step every word contracts the
occurrences of its pair of least rank, leftmost first, until no word has a pair left; an ordered aggregation gives the
ids. All occurrences of one pair may go in one step, since any pair that arises from a merge has a later rank. In long
words a step also takes pairs that no neighbour can break, which leaves few steps even for words of millions of bytes. Words are
first cut where no token of the vocabulary has the two bytes side by side, as no merge can cross such a place.

The vocabulary has a fixed size and is broadcast; texts never leave their partition.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tarnwell.tables import own_name, read_table

#: Folder of the vocabulary files; a parameter of every operator here.
TOKENIZERS = os.environ.get("TARNWELL_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"

# The white space of Unicode, and the pattern that parts words before merging.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: A worker forgets the words it knows beyond so many words or tokens; they are encoded again when they come again.
KNOWN_WORDS, KNOWN_TOKENS = 300_000, 4_000_000
#: Bytes of new words in one recursive query; fewer where words are long, for a query keeps the rows of all its steps.
QUERY_BYTES, LONG_QUERY_BYTES = 250_000, 50_000

# Memory and threads of DuckDB within a Python worker; it must not spill to a local disk.
_SETTINGS = "SET memory_limit='400MB'; SET threads=1; SET temp_directory=''; SET preserve_insertion_order=false"

#: Pieces up to so many bytes are encoded together by one rank a step; longer ones by all ranks that are safe.
SHORT_BYTES = 64
#: Pieces beyond so many bytes are contracted by the same steps on an array, for DuckDB's windows would outgrow its share.
LONG_BYTES = 4_000

# A step: where every word has its pair of least rank, and with {safe} also where no neighbour can be merged with either
# half at a lower rank, whatever it grows to. Of occurrences that overlap (a run of one token) every second is taken.
_STEP = """
    SELECT word, pos, CASE WHEN chosen THEN merged_id ELSE token END AS token {more}
    FROM (
        SELECT *, lag(chosen, 1, false) OVER (PARTITION BY word ORDER BY pos) AS gone
        FROM (
            SELECT *, safe OR (hit AND (row_number() OVER (PARTITION BY word, hit, run ORDER BY pos)) % 2 = 1) AS chosen
            FROM (
                SELECT *, place - row_number() OVER (PARTITION BY word, hit ORDER BY pos) AS run
                FROM (
                    SELECT *, coalesce(merged_id = best, false) AS hit, {safe} AS safe
                    FROM (
                        SELECT p.*, m.id AS merged_id, min(m.id) OVER (PARTITION BY p.word) AS best {least}
                        FROM (
                            SELECT *, lead(token) OVER w AS follower, row_number() OVER w AS place {around}
                            FROM {state} WINDOW w AS (PARTITION BY word ORDER BY pos)
                        ) p LEFT JOIN merges m ON m.a = p.token AND m.b = p.follower {joins}
                    ) WHERE best IS NOT NULL
                )
            )
        )
    ) WHERE NOT gone
"""
_PLAIN = {"safe": "false", "least": "", "around": "", "joins": ""}
_SAFE = {
    "safe": "coalesce(merged_id < coalesce(from_left, 2147483647) AND merged_id < coalesce(from_right, 2147483647), false)",
    "least": ", l.least AS from_left, r.least AS from_right",
    "around": ", lag(token) OVER w AS before, lead(token, 2) OVER w AS after",
    "joins": "LEFT JOIN left_of l ON l.s = p.before AND l.t = p.token LEFT JOIN right_of r ON r.t = p.follower AND r.s = p.after",
}


def _recursive(parts: dict) -> str:
    step = _STEP.format(state="bpe", more=", step + 1", **parts)
    return f"""
        WITH RECURSIVE bpe(word, pos, token, step) AS (SELECT word, pos, token, 0 FROM start UNION ALL {step})
        SELECT word, list(token ORDER BY pos) AS ids
        FROM (SELECT *, max(step) OVER (PARTITION BY word) AS last FROM bpe)
        WHERE step = last GROUP BY word ORDER BY word"""


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for n, b in enumerate(x for x in range(256) if x not in set(plain)):
        letters[chr(256 + n)] = b
    return letters


def load_vocabulary(path: str) -> dict:
    """Ids of the 256 bytes, the merge table (left, right, id) by rank, and which two bytes stand side by side in a token."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    ids, letters = model["vocab"], _byte_letters()
    base = np.zeros(256, np.int32)
    for letter, byte in letters.items():
        base[byte] = ids[letter]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = np.array([(ids[a], ids[b], ids[a + b]) for a, b in pairs], np.int32)
    if np.any(np.diff(merges[:, 2]) <= 0):
        raise ValueError("ids must follow the ranks of the merges")
    side_by_side = np.zeros(65536, bool)
    for a, b in pairs:
        side_by_side[letters[a[-1]] * 256 + letters[b[0]]] = True
    return {"base": base, "merges": merges, "side_by_side": side_by_side}


def _neighbours(merges: np.ndarray) -> tuple[list, list, list]:
    """For a token and its neighbour, the least rank at which what they may grow to merges, as three lists of rows.

    In (neighbour before, token, rank) only the neighbour grows, in (token, neighbour after, rank) too; in (left, right,
    rank) both do, so no merge ever crosses a place whose two tokens aren't listed. Every token has one pair that it is
    merged from, so what may become its last part is the chain of its right halves, its first part that of its left ones.
    """
    halves = {int(c): (int(a), int(b)) for a, b, c in merges}

    def chain(token: int, side: int) -> Iterator[int]:
        yield token
        while token in halves:
            token = halves[token][side]
            yield token

    before: dict[tuple[int, int], int] = {}
    after: dict[tuple[int, int], int] = {}
    across: dict[tuple[int, int], int] = {}
    for a, b, c in merges.tolist():  # by rank, so the first is the least
        for s in chain(a, 1):
            before.setdefault((s, b), c)
        for s in chain(b, 0):
            after.setdefault((a, s), c)
            for t in chain(a, 1):
                across.setdefault((t, s), c)
    return tuple([(x, y, c) for (x, y), c in pairs.items()] for pairs in (before, after, across))


#: Stands for no rank.
_NONE = np.iinfo(np.int64).max


def _lookup(rows) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function from two arrays of tokens to the rank of each pair, by binary search."""
    a, b, c = np.array(rows, np.int64).T
    keys = a << 32 | b
    order = np.argsort(keys)
    keys, ranks = keys[order], c[order]

    def find(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        wanted = x.astype(np.int64) << 32 | y
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, ranks[at], _NONE)

    return find


class Encoder:
    """Encodes batches of texts; what it knows of words stays from batch to batch."""

    def __init__(self, vocabulary: dict) -> None:
        import duckdb

        self._base, self._beside = vocabulary["base"], vocabulary["side_by_side"]
        self._words = regex.compile(PATTERN).findall
        self._db = duckdb.connect(":memory:")
        self._db.execute(_SETTINGS)
        a, b, c = vocabulary["merges"].T
        self._db.register("given", pa.table({"a": a, "b": b, "id": c}))
        self._db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self._db.unregister("given")
        self._merges, self._long_ready = vocabulary["merges"], False
        self._forget()

    def _prepare_long(self) -> None:
        if not self._long_ready:
            before, after, across = _neighbours(self._merges)
            for name, columns, rows in (("left_of", ("s", "t", "least"), before), ("right_of", ("t", "s", "least"), after)):
                given = pa.table({c: pa.array(x, pa.int32()) for c, x in zip(columns, zip(*rows))})
                self._db.register("given", given)
                self._db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
                self._db.unregister("given")
            self._rank, self._before, self._after, self._across = map(_lookup, (self._merges, before, after, across))
            self._long_ready = True

    def _forget(self) -> None:
        self._codes: dict[str, int] = {}
        self._ids: list[np.ndarray] = []
        self._flat = np.zeros(0, np.int32)
        self._starts = np.zeros(1, np.int64)

    def _start(self, pieces: list[bytes]) -> pa.Table:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        word = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        pos = (np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        return pa.table({"word": word, "pos": pos, "token": self._base[np.frombuffer(b"".join(pieces), np.uint8)]})

    def _query(self, pieces: list[bytes], parts: dict) -> list[np.ndarray]:
        self._db.register("start", self._start(pieces))
        ids = self._db.sql(_recursive(parts)).to_arrow_table().column("ids").combine_chunks()
        self._db.unregister("start")
        values, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
        return [values[x:y] for x, y in zip(offsets, offsets[1:])]

    def _contract_array(self, piece: bytes) -> np.ndarray:
        """The same steps on an array, for words whose rows would not fit into DuckDB's share of memory.

        The least rank is sought between places that no merge can cross, as words are cut before their first step.
        """
        token = self._base[np.frombuffer(piece, np.uint8)]
        while len(token) > 1:
            rank = self._rank(token[:-1], token[1:])
            starts = np.concatenate([[0], np.nonzero(self._across(token[:-1], token[1:]) == _NONE)[0]])
            starts = np.unique(starts)
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(rank))))
            if best.min() == _NONE:
                break
            left, right = np.full(len(rank), _NONE), np.full(len(rank), _NONE)
            left[1:] = self._before(token[:-2], token[1:-1])
            right[:-1] = self._after(token[1:-1], token[2:])
            hit = (rank == best) & (rank < _NONE)
            first = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), np.arange(len(hit)), 0))
            chosen = ((rank < left) & (rank < right) & (rank < _NONE)) | (hit & ((np.arange(len(hit)) - first) % 2 == 0))
            gone = np.concatenate([[False], chosen])
            token = np.where(np.concatenate([chosen, [False]]), np.concatenate([rank, [0]]), token)[~gone].astype(np.int32)
        return token

    def _contract(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece, by recursive queries over pieces of like length and bounded size together."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        short = [i for i, p in enumerate(pieces) if len(p) <= SHORT_BYTES]
        middle = [i for i, p in enumerate(pieces) if SHORT_BYTES < len(p) <= LONG_BYTES]
        if len(short) < len(pieces):
            self._prepare_long()
        for chosen, parts, most in ((short, _PLAIN, QUERY_BYTES), (middle, _SAFE, LONG_QUERY_BYTES)):
            at = 0
            while at < len(chosen):
                end, size = at, 0
                while end < len(chosen) and (size == 0 or size + len(pieces[chosen[end]]) <= most):
                    size += len(pieces[chosen[end]])
                    end += 1
                for i, ids in zip(chosen[at:end], self._query([pieces[i] for i in chosen[at:end]], parts)):
                    out[i] = ids
                at = end
        for i, p in enumerate(pieces):
            if len(p) > LONG_BYTES:
                out[i] = self._contract_array(p)
        return out

    def _learn(self, words: list[str]) -> None:
        """Encodes words that are not known yet, each once, cut where no merge can cross."""
        pieces: dict[bytes, int] = {}
        made: list[list[int]] = []
        for word in words:
            raw = word.encode("utf-8", "replace")
            if len(raw) > 1:
                letters = np.frombuffer(raw, np.uint8).astype(np.int32)
                cuts = (np.nonzero(~self._beside[letters[:-1] * 256 + letters[1:]])[0] + 1).tolist()
                parts = [raw[x:y] for x, y in zip([0, *cuts], [*cuts, len(raw)])]
            else:
                parts = [raw]
            made.append([pieces.setdefault(p, len(pieces)) for p in parts])
        encoded = self._contract(list(pieces))
        self._ids += [encoded[m[0]] if len(m) == 1 else np.concatenate([encoded[i] for i in m]) for m in made]

    def codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts as numbers, and where each text's words end."""
        if len(self._ids) > KNOWN_WORDS or len(self._flat) > KNOWN_TOKENS:
            self._forget()
        known, new, out, ends = self._codes, [], [], np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            if text:
                for word in self._words(text):
                    code = known.get(word)
                    if code is None:
                        code = known[word] = len(known)
                        new.append(word)
                    out.append(code)
            ends[i + 1] = len(out)
        if new:
            self._learn(new)
            lengths = np.fromiter(map(len, self._ids), np.int64, len(self._ids))
            self._starts = np.concatenate([[0], np.cumsum(lengths)])
            self._flat = np.concatenate(self._ids)
        return np.array(out, np.int64), ends

    def sizes(self, texts: list[str | None]) -> np.ndarray:
        """Number of tokens of each text."""
        words, ends = self.codes(texts)
        running = np.concatenate([[0], np.cumsum(np.diff(self._starts)[words])])
        return running[ends[1:]] - running[ends[:-1]]

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text."""
        words, ends = self.codes(texts)
        lengths = np.diff(self._starts)[words]
        running = np.concatenate([[0], np.cumsum(lengths)])
        if len(words):
            take = np.arange(running[-1]) + np.repeat(self._starts[:-1][words] - running[:-1], lengths)
            values = self._flat[take]
        else:
            values = np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(running[ends].astype(np.int32)), pa.array(values, pa.int32()))


_encoders: dict[str, Encoder] = {}


def worker_encoder(key: str, broadcast) -> Encoder:
    """This worker's encoder for a broadcast vocabulary; it outlives tasks."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(broadcast.value)
    return _encoders[key]


def _shared(spark: SparkSession, folder: str, vocabulary: str) -> tuple[str, object]:
    loaded = load_vocabulary(os.path.join(folder, vocabulary))
    return hashlib.sha256(loaded["merges"].tobytes()).hexdigest(), spark.sparkContext.broadcast(loaded)


def _slices(texts: pa.Array, most: int) -> Iterator[list]:
    """The texts in runs of at most ``most`` characters together, or of one text."""
    values = texts.to_pylist()
    start = size = 0
    for i, text in enumerate(values):
        n = len(text or "")
        if i > start and size + n > most:
            yield values[start:i]
            start, size = i, 0
        size += n
    if start < len(values):
        yield values[start:]


#: Characters that a worker encodes at once; it bounds its memory whatever the batch holds.
SLICE_CHARS = 4_000_000


def token_ids(spark: SparkSession, text: Column, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """The ids of a text, without special tokens (their strings are ordinary text); null and empty texts give ``[]``."""
    key, shared = _shared(spark, folder, vocabulary)

    @F.arrow_udf(ArrayType(IntegerType()))
    def encode(texts: pa.Array) -> pa.Array:
        encoder = worker_encoder(key, shared)
        parts = [encoder.encode(x) for x in _slices(texts, SLICE_CHARS)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return encode(text)


def token_count(spark: SparkSession, text: Column, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """The number of ids of a text; 0 for null and empty texts."""
    key, shared = _shared(spark, folder, vocabulary)

    @F.arrow_udf(IntegerType())
    def count(texts: pa.Array) -> pa.Array:
        encoder = worker_encoder(key, shared)
        parts = [encoder.sizes(x) for x in _slices(texts, SLICE_CHARS)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.int32())

    return count(text)


def token_bytes(vocabulary: dict) -> dict[int, bytes]:
    """The bytes of every token: those of the pair that it was merged from, down to single bytes."""
    out = {int(i): bytes([b]) for b, i in enumerate(vocabulary["base"])}
    for a, b, c in vocabulary["merges"].tolist():  # by rank, so both halves are known
        out[c] = out[a] + out[b]
    return out


#: Tokens that one query decodes.
DECODED_TOKENS = 500_000


class Decoder:
    """Decodes batches of ids: token-position rows join the table of tokens, an ordered aggregation gives the text."""

    _QUERY = """SELECT list, CASE WHEN count(*) = count(written) THEN unhex(string_agg(written, '' ORDER BY pos)) END AS raw
        FROM given LEFT JOIN tokens USING (id) GROUP BY list ORDER BY list"""

    def __init__(self, vocabulary: dict) -> None:
        import duckdb

        self._db = duckdb.connect(":memory:")
        self._db.execute(_SETTINGS)
        tokens = token_bytes(vocabulary)
        self._db.register("given", pa.table({"id": pa.array(tokens, pa.int32()), "written": [b.hex() for b in tokens.values()]}))
        self._db.execute("CREATE TABLE tokens AS SELECT * FROM given")
        self._db.unregister("given")

    def decode(self, lists: pa.ListArray) -> list[str | None]:
        """The text of each list of ids; null for null and for ids that no token has, an empty text for an empty list."""
        out: list[str | None] = ["" if v else None for v in lists.is_valid().to_pylist()]
        sizes = np.array(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
        at = 0
        while at < len(out):
            end, total = at, 0
            while end < len(out) and (end == at or total + sizes[end] <= DECODED_TOKENS):
                total += sizes[end]
                end += 1
            part = lists.slice(at, end - at)
            ids, counts = part.flatten(), sizes[at:end]
            number = np.repeat(np.arange(end - at), counts)
            pos = np.arange(len(number)) - np.repeat(np.cumsum(counts) - counts, counts)
            self._db.register("given", pa.table({"list": pa.array(number, pa.int32()), "pos": pa.array(pos, pa.int32()), "id": ids.cast(pa.int32())}))
            for n, raw in self._db.sql(self._QUERY).fetchall():
                out[at + n] = None if raw is None else raw.decode("utf-8", "replace")
            self._db.unregister("given")
            at = end
        return out


_decoders: dict[str, Decoder] = {}


def token_text(spark: SparkSession, ids: Column, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """The text that a list of ids stands for; null lists and ids that no token has give null."""
    key, shared = _shared(spark, folder, vocabulary)

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        if key not in _decoders:
            _decoders.clear()
            _decoders[key] = Decoder(shared.value)
        return pa.array(_decoders[key].decode(lists), pa.string())

    return decode(ids)


def encoded(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS) -> DataFrame:
    """``(key, ids)`` of each row; null and empty texts have no ids, repeated rows repeat, a key named ids gets an underscore."""
    return df.select(F.col(key).alias(own_name(key, ("ids",))), token_ids(df.sparkSession, F.col(text), folder).alias("ids"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Query p7_ids."""
    return encoded(read_table(spark, folder, "documents"), "doc_id", "text")


def p7_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Query p7_texts: every document's text, encoded and decoded again; null texts come back empty."""
    ids = p7_ids(spark, folder)
    return ids.select("doc_id", token_text(spark, F.col("ids")).alias("text"))
