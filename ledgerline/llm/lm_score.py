"""Language-model scores by stupid backoff: count tables by hash, joined to the n-grams of documents.

The model is the corpus itself, less the document that is scored: n-grams of one to ORDER words are counted
over all rows, with an end mark after each text, and a row's own occurrences don't count for it. A word
after others scores count(n-gram) / count(n-gram without its last word) for the longest n-gram that ends
with it and occurs in another row, times BACKOFF for each word that had to be given up; a word that
occurs in no other row scores BACKOFF ** ORDER over the words of the other rows and one. The score of a
document is the sum of the logarithms over its words and the end mark.

An n-gram a row would shuffle many times the corpus, so rows carry many: documents are gathered into
blocks of BLOCK words, kept as a table, and a block asks for the counts of its distinct n-grams with one
packed row for each partition of the count tables that it needs, sorted and packed as differences. The
table of blocks is in buckets, so that answers come to the blocks and blocks are never shuffled. A
partition of the hash space sums what all blocks report, which is the count table for its share of the
n-grams, and answers each block in the order it was asked; a block with its answers scores its documents.
There are as many partitions as PART n-grams in each need, so none outgrows memory, and rows can't exceed
the distinct n-grams of blocks. An n-gram costs a block one entry however often it occurs, so frequent
words and phrases weigh no more than others.

Defined results: identifiers are whole numbers or text of their digits, and other text stops the job with Spark's
cast error; null and wordless texts have the end mark alone; each row is scored as a document of its
own, also where rows share an identifier or have none; an empty table gives an empty result; a single row
has no other to count; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .neardup import _Hashes, _mix

ORDER = 3
BACKOFF = 0.4
#: Words of a block; a longer document is a block of its own.
BLOCK = 1_000_000
#: n-grams that a partition of the count tables is asked for, on average.
PART = 4_000_000
#: Bits of an n-gram's hash beyond those that number all words: one count in 2 ** SPARE is another's, too.
SPARE = 24

_END = np.uint64(0)
_TIMES = np.uint64(0x9E3779B97F4A7C15)
_BLOCKS = "block long, n long, ids array<string>, lengths array<int>, words binary, places binary"
_ASKED = "block long, part int, sizes array<int>, keys binary, counts binary"
_TOLD = "block long, part int, counts binary"
_SCORES = "doc_id long, n_words long, s double, n_backoff long"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _pack(a: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed: equal planes and zeros cost next to nothing."""
    import zstandard

    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _make_blocks(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        hashes = _Hashes()
        ids, parts, held = [], [], 0

        def close() -> pd.DataFrame:
            words, places, often = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            # frequent words get small numbers, which pack best
            order = np.argsort(-often, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            row = (uuid.uuid4().int >> 65, held, list(ids), [len(p) for p in parts], _pack(words[order]), _pack(rank[places]))
            ids.clear()
            parts.clear()
            return pd.DataFrame([row], columns=_names(_BLOCKS))

        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                words = text.lower().encode("utf-8", "surrogatepass").split() if text else []
                coded = np.empty(len(words) + 1, np.uint64)
                coded[:-1] = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                coded[-1] = _END
                ids.append(doc_id)
                parts.append(coded)
                held += len(coded)
                if held >= size:
                    yield close()
                    held = 0
        if parts:
            yield close()

    return run


def _grams(row, order: int) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """For each length: distinct n-grams, the n-gram that ends at each word, and whether it lies in the text; then the row of each word, and row starts."""
    words, places = _unpack(row.words, np.uint64), _unpack(row.places, np.int32)
    lengths = np.asarray(row.lengths)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(int)
    of = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(places)) - starts[of]
    coded = words[places]
    out, now = [], np.zeros(len(coded), np.uint64)
    for n in range(1, order + 1):
        now = coded if n == 1 else np.concatenate([[_END], now[:-1]]) * _TIMES + coded
        keys, where = np.unique(_mix(now + np.uint64(n)), return_inverse=True)
        out.append((keys, where, at >= n - 1))
    return out, of, starts


def _cut(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where sorted keys pass from one partition to the next: partitions are ranges of the hash space."""
    edges = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(int)


def _ask(parts: int, order: int, spare: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                grams, _, _ = _grams(row, order)
                counts = [np.bincount(where[inside], minlength=len(keys)).astype(np.uint32) for keys, where, inside in grams]
                cuts = [_cut(keys, parts) for keys, _, _ in grams]
                out = []
                for p in range(parts):
                    mine = [slice(c[p], c[p + 1]) for c in cuts]
                    sizes = [m.stop - m.start for m in mine]
                    if sum(sizes):
                        # the upper bits of a key, as the difference from the one before
                        asked = [np.diff(keys[m] >> np.uint64(spare), prepend=np.uint64(0)) for (keys, _, _), m in zip(grams, mine, strict=True)]
                        out.append((row.block, p, sizes, _pack(np.concatenate(asked)), _pack(np.concatenate([c[m] for c, m in zip(counts, mine, strict=True)]))))
                    if len(out) >= 500:
                        yield pd.DataFrame(out, columns=_names(_ASKED))
                        out = []
                yield pd.DataFrame(out, columns=_names(_ASKED))

    return run


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sum what all blocks report of one partition, and answer each of them in its own order."""
    sizes = np.array([list(s) for s in pdf["sizes"]])
    asked = [np.split(_unpack(k, np.uint64), np.cumsum(s)[:-1]) for k, s in zip(pdf["keys"], sizes, strict=True)]
    own = [np.split(_unpack(c, np.uint32), np.cumsum(s)[:-1]) for c, s in zip(pdf["counts"], sizes, strict=True)]
    answers: list[list[np.ndarray]] = [[] for _ in asked]
    for n in range(sizes.shape[1]):
        keys = np.concatenate([np.cumsum(a[n], dtype=np.uint64) for a in asked])
        _, of = np.unique(keys, return_inverse=True)
        total = np.bincount(of, weights=np.concatenate([c[n] for c in own])).astype(np.uint64)[of] if len(keys) else keys
        for mine, part in zip(answers, np.split(total, np.cumsum(sizes[:, n])[:-1]), strict=True):
            mine.append(part)
    return pdf[["block", "part"]].assign(counts=[_pack(np.concatenate(a)) for a in answers])


def _own(of: np.ndarray, where: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """For each word how often its n-gram occurs in its own row."""
    _, pair, times = np.unique(of * np.int64(where.max() + 1) + where, return_inverse=True, return_counts=True)
    if not inside.all():
        times = np.bincount(pair, weights=inside).astype(np.int64)
    return times[pair]


def _score(total: int, parts: int, order: int, backoff: float):
    def run(blocks: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in blocks.itertuples(index=False):
            grams, of, starts = _grams(row, order)
            cuts = [_cut(keys, parts) for keys, _, _ in grams]
            counts = [np.zeros(len(keys)) for keys, _, _ in grams]
            for part, packed in zip(told["part"], told["counts"], strict=True):
                mine = [slice(c[part], c[part + 1]) for c in cuts]
                for c, m, answer in zip(counts, mine, np.split(_unpack(packed, np.uint64), np.cumsum([m.stop - m.start for m in mine])[:-1]), strict=True):
                    c[m] = answer
            lengths = np.asarray(row.lengths)
            others = (total - lengths)[of]
            # what other rows have of each n-gram, by length
            rest = [c[where] - _own(of, where, inside) for c, (_, where, inside) in zip(counts, grams, strict=True)]
            score, done = np.full(len(of), order * np.log(backoff)) - np.log(others + 1), np.zeros(len(of), bool)
            for n in range(order, 0, -1):
                inside = grams[n - 1][2]
                hit = inside & ~done & (rest[n - 1] > 0)
                # the n-gram without its last word ends one word earlier
                below = np.concatenate([[1.0], rest[n - 2][:-1]]) if n > 1 else others
                score[hit] = np.log(rest[n - 1][hit] / below[hit]) + (order - n) * np.log(backoff)
                if n == order:
                    whole = hit
                done |= hit
            ids = pd.to_numeric(pd.Series(list(row.ids), dtype="string")).astype("Int64")
            out.append(pd.DataFrame({"doc_id": ids, "n_words": lengths.astype(np.int64), "s": np.add.reduceat(score, starts), "n_backoff": np.add.reduceat((~whole).astype(np.int64), starts)}))
        return pd.concat(out) if out else pd.DataFrame({"doc_id": pd.array([], "Int64"), "n_words": np.empty(0, np.int64), "s": np.empty(0), "n_backoff": np.empty(0, np.int64)})

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, block: int = BLOCK, part: int = PART) -> DataFrame:
    """(doc_id, n_words, log_score, n_backoff): n_words counts the end mark, n_backoff the words whose longest n-gram no other row has."""
    # as text, since pandas makes floats of numbers with nulls
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = stage(rows.mapInPandas(_make_blocks(block), _BLOCKS), by="block")
    total = blocks.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total * order // part))
    asked = blocks.mapInPandas(_ask(parts, order, max(0, 64 - SPARE - total.bit_length())), _ASKED)
    told = asked.groupBy("part").applyInPandas(_count, _TOLD)
    scored = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(_score(total, parts, order, backoff), _SCORES)
    return scored.select("doc_id", "n_words", F.col("s").alias("log_score"), "n_backoff")
