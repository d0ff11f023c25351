"""Benchmark decontamination with one Aho-Corasick automaton over words.

Texts are normalised alike: A-Z to lower case, words are runs of 0-9, a-z and non-ASCII characters.
Every item is cut into windows of ``width`` consecutive words (an item of fewer words is one window);
all windows go into one automaton whose symbols are word numbers, so that a text is scanned once and a
match says directly which words it covers. Spans of the original text are found again for texts with
matches only.

The automaton travels to the executors, so its size is bounded: items are taken in blocks of at most
``block_windows`` windows (more blocks scan the texts again and add to what was found). At the sizes of
public benchmarks there is one block.

Defined results: null or wordless texts have no words, no hits and are clean; items without words have
no window; repeated item texts each count under their own item_id; repeated documents are rows of their
own; without items everything is clean; null item_ids are left out of the list of items.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

WIDTH = 10
#: Windows in one automaton; about 0.5 KB each.
BLOCK_WINDOWS = 400_000

#: On UTF-8 bytes, _WORD is the class of words: digits, letters, and whatever is not ASCII.
_FOUND = "n_words long, covered array<long>, items array<string>, spans array<long>"
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Normalised words: bytes.lower() changes A-Z alone."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def _windows(words: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def _blocks(items: DataFrame, id_col: str, text_col: str, width: int, limit: int):
    """Lists of (item id, words); each with at most ``limit`` windows, unless one item alone has more."""
    block, used = [], 0
    for row in items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        words = words_of(row["t"])
        n = len(_windows(words, width))
        if n and used + n > limit and block:
            yield block
            block, used = [], 0
        if n:
            block.append((row["i"], words))
            used += n
    yield block


def _automaton(block, width):
    """The automaton, the numbers of words, and for each window the items that have it."""
    import ahocorasick

    number: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set] = {}
    for item, words in block:
        for window in _windows(words, width):
            owners.setdefault(tuple(number.setdefault(w, len(number) + 1) for w in window), set()).add(item)
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    listed = list(owners.items())
    for k, (window, _) in enumerate(listed):
        machine.add_word(window, k)
    machine.make_automaton()
    return machine, number, [len(w) for w, _ in listed], [o for _, o in listed]


def _scan(sent, width: int, places: bool):
    """The pandas UDF that scans with one block of items, and adds to what earlier blocks have found."""

    @F.pandas_udf(_FOUND)
    def scan(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        machine, number, lengths, owners = _automaton(sent.value, width)
        known = number.get
        for texts, before in batches:
            out = []
            for text, had, of in zip(texts, before["covered"], before["items"], strict=True):
                words = words_of(text)
                spans, items = list(zip(had[::2], had[1::2], strict=True)), set(of)
                for end, k in machine.iter(tuple([known(w, 0) for w in words])) if lengths else ():
                    spans.append((end + 1 - lengths[k], end + 1))
                    items.update(owners[k])
                covered = [int(x) for span in _merged(spans) for x in span]
                out.append((len(words), covered, sorted(x for x in items if x is not None), original_spans(text, covered) if places and covered else []))
            yield pd.DataFrame(out, columns=["n_words", "covered", "items", "spans"])

    return scan


def _merged(spans):
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def original_spans(text: str | None, covered) -> list[int]:
    """Start and end in code points of the original text for each covered run of words, flat."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    at = [m.span() for m in _WORD.finditer(raw)]
    flat = [x for a, b in zip(covered[::2], covered[1::2], strict=True) for x in (at[a][0], at[b - 1][1])]
    return [len(raw[:x].decode("utf-8", "surrogatepass")) for x in flat]


def find_contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_windows: int = BLOCK_WINDOWS, spans: bool = False, column: str = "contamination") -> DataFrame:
    """docs with one more column, or with that column replaced: a struct of n_words, n_hit, items (as sorted strings) and,
    if asked for, spans (start and end of each hit run in the original text, flat)."""
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c.lower() != column.lower()]
    found = F.struct(F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("covered"), F.array().cast("array<string>").alias("items"), F.array().cast("array<long>").alias("spans"))
    for block in _blocks(items, item_id, item_text, width, block_windows):
        found = _scan(spark.sparkContext.broadcast(block), width, spans)(F.col(text_col), found)
    out = docs.select(*[f"`{c}`" for c in keep], found.alias(column))
    at = F.col(column)
    n_hit = F.aggregate(F.transform(at["covered"], lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    parts = [at["n_words"].alias("n_words"), n_hit.alias("n_hit"), at["items"].alias("items")]
    if spans:
        parts.append(at["spans"].alias("spans"))
    return out.withColumn(column, F.struct(*parts))


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs without a word of any window; their columns as they were."""
    own = fresh(docs, "contamination")
    return find_contamination(docs, items, column=own, **options).filter(F.col(own)["n_hit"] == 0).select(*[f"`{c}`" for c in docs.columns])


def digest(items: list[str]) -> str:
    """What op6 reports of a list of items; for tests."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()
