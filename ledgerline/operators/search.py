"""Full-text search over a postings table, and search by cosine."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.stem import stem, stems


def _words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, term): lower-case runs of letters and digits."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return docs.select(F.col(id_col).alias("id"), F.posexplode(words).alias("pos", "term"))


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, id, tf, positions): lower-case runs of letters and digits."""
    return _grouped(_words(docs, id_col, text_col))


def _grouped(words: DataFrame) -> DataFrame:
    return words.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def parse_query(query: str) -> tuple[list[list[list[str]]], list[list[str]]]:
    """(alternatives per clause, exclusions): words and quoted phrases, OR between clauses' alternatives, - for exclusion."""
    clauses: list[list[list[str]]] = []
    without: list[list[str]] = []
    join_next = False
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if word.upper() == "OR" and not minus:
            join_next = bool(clauses)
            continue
        terms = re.findall(r"[^\W_]+", (phrase or word).lower())
        if not terms:
            continue
        if minus:
            without.append(terms)
        elif join_next:
            clauses[-1].append(terms)
        else:
            clauses.append([terms])
        join_next = False
    return clauses, without


def full_text(index: DataFrame, query: str, form=lambda word: word) -> DataFrame:
    """(id, rank): documents that meet every clause and no exclusion; rank is the sum of ln(1 + tf) of the words asked for.

    The postings of the query's words alone are read, and grouped once by document. form: what the index has for a word.
    """
    clauses, without = parse_query(query)
    clauses, without = [[[form(t) for t in alt] for alt in c] for c in clauses], [[form(t) for t in alt] for alt in without]
    wanted = sorted({t for c in clauses for alt in c for t in alt})
    if not wanted:
        return index.select("id", F.lit(0.0).alias("rank")).limit(0)
    terms = sorted(set(wanted) | {t for alt in without for t in alt})
    at = index.filter(F.col("term").isin(*terms)).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"), F.sum(F.when(F.col("term").isin(*wanted), F.log1p("tf")).otherwise(0.0)).alias("rank"))

    def phrase(words: list[str]) -> Column:
        first = F.col("at")[words[0]]
        if len(words) == 1:
            return first.isNotNull()
        follow = lambda p: reduce(and_, [F.array_contains(F.col("at")[w], p + k) for k, w in enumerate(words[1:], 1)])
        return F.coalesce(F.exists(first, follow), F.lit(False))

    for clause in clauses:
        hit = phrase(clause[0])
        for alternative in clause[1:]:
            hit = hit | phrase(alternative)
        at = at.filter(hit)
    for words in without:
        at = at.filter(~phrase(words))
    return at.select("id", "rank")


#: Parts of a kept index; a query reads those of its words.
PARTS = 64
#: Characters of the documents that one task indexes: their occurrences take some 400 MB, which is sorted without spilling.
TASK_CHARS = 32_000_000


class TextIndex:
    """Postings kept as a table, so that any number of queries share one pass over the documents.

    ``postings`` has an occurrence a row, in parts by hash of the term, each part in files by document, each file sorted, so that a frequent term isn't one task's; ``dictionary``
    has each term once, with its stem and how often it occurs. A query reads the parts of its words alone, and groups what it finds by document.
    """

    def __init__(self, spark, path: str) -> None:
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, docs: DataFrame, id_col: str, text_col: str, path: str) -> TextIndex:
        """Write the occurrences of some documents, each where its document is: texts are shuffled, and not their words. The dictionary follows with the first search for stems."""
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        tasks = 1 + (texts.agg(F.sum(F.length("text"))).first()[0] or 0) // TASK_CHARS
        each = _words(texts.repartition(tasks, "id"), "id", "text").withColumn("part", cls._part(F.col("term")))
        each.sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
        return cls(docs.sparkSession, path)

    def _dictionary(self) -> DataFrame:
        """(term, stem, occurrences), written once."""
        jvm = self.spark.sparkContext._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{self.path}/dictionary/_SUCCESS")
        if not done.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            words = self._table("postings").groupBy("term").agg(F.count(F.lit(1)).alias("occurrences"))
            words.withColumn("stem", stems(F.col("term"))).sortWithinPartitions("stem").write.mode("overwrite").parquet(f"{self.path}/dictionary")
        return self._table("dictionary")

    @staticmethod
    def _part(term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _of(self, words: list[str]) -> DataFrame:
        """Postings of some words: their occurrences by document. The parts are constants, so the others aren't read."""
        rows = self._table("postings")
        rows = rows.filter(F.col("part").isin([self._part(F.lit(w)) for w in words]) & F.col("term").isin(words)) if words else rows.limit(0)
        return _grouped(rows)

    def search(self, query: str, stemmed: bool = True) -> DataFrame:
        """(id, rank) as ``full_text`` has it; stemmed: words stand for all words of their stem, and so in phrases."""
        clauses, without = parse_query(query)
        asked = sorted({t for alt in [*[a for c in clauses for a in c], *without] for t in alt})
        if not asked:
            return full_text(self._of([]), query)
        if not stemmed:
            return full_text(self._of(asked), query)
        forms = self._dictionary().filter(F.col("stem").isin(sorted({stem(t) for t in asked}))).select("term", "stem")
        listed = [r["term"] for r in forms.collect()]  # inflections of the words asked for
        merged = self._of(listed).join(F.broadcast(forms), "term").groupBy(F.col("stem").alias("term"), "id").agg(F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
        return full_text(merged, query, stem)


#: Queries and vectors of a block: their products take 64 MB.
ASKED, SEARCHED = 512, 16_384


def _nearest(k: int, own: bool):
    """The k nearest vectors of one block for each query of another."""

    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        names = ["query", "id", "similarity"]
        if asked.empty or held.empty:
            return pd.DataFrame(columns=names)
        q, v, ids = np.stack(asked["vector"].to_numpy()), np.stack(held["vector"].to_numpy()), held["id"].to_numpy()
        near = np.round(q @ v.T / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)), 12)
        out = []
        for query, row in zip(asked["id"].to_numpy(), near, strict=True):
            if not own:
                row = np.where(ids == query, -np.inf, row)
            least = np.partition(row, -k)[-k] if k < len(row) else -np.inf
            at = np.flatnonzero((row >= least) & (row > -np.inf))
            at = at[np.lexsort((ids[at], -row[at]))][:k]
            out.append(pd.DataFrame({"query": query, "id": ids[at], "similarity": row[at]}, columns=names))
        return pd.concat(out)

    return search


def semantic(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", where: Column | None = None, own: bool = True) -> DataFrame:
    """(query, rank, id, similarity): the k vectors nearest to each query by cosine, over all vectors or those that a condition keeps.

    Blocks of queries meet blocks of vectors of their length, each pair of blocks in one task, and the k best of each
    are merged. Cosines that are equal to twelve places tie, and the smaller identifier comes first. Vectors that are
    null, zero or hold nulls or values that aren't finite take no part; without ``own`` a query doesn't find itself.
    Identifiers are those of rows.
    """
    doubles = F.col(vector_col).cast("array<double>")
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)  # null or not a number if a component is

    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).alias("id"), doubles.alias("vector"))
        return rows.filter(F.col("id").isNotNull() & (norm > 0) & (norm < float("inf"))).withColumn("length", F.size("vector"))

    asked, held = usable(queries), usable(vectors if where is None else vectors.filter(where))
    q, v = max(1, -(-asked.count() // ASKED)), max(1, -(-held.count() // SEARCHED))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    asked = asked.withColumn("q", block(q)).withColumn("v", each(v))
    held = held.withColumn("v", block(v)).withColumn("q", each(q))
    kind = vectors.schema[id_col].dataType.simpleString()
    found = asked.groupBy("length", "q", "v").cogroup(held.groupBy("length", "q", "v")).applyInPandas(_nearest(k, own), f"query {kind}, id {kind}, similarity double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "rank", "id", "similarity")


def neighbours(vectors: DataFrame, seeds: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest of each seed other than itself; none if it has no vector."""
    return semantic(vectors, seeds, k, id_col, vector_col, own=False)


def embedding_text(body: Column, subject: Column, limit: int | None = None) -> Column:
    """What is embedded of a message: its body, or the start of it that a caller asks for, else its subject, else a placeholder."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(some(body if limit is None else F.substring(body, 1, limit)), some(subject), F.lit("(empty)"))
