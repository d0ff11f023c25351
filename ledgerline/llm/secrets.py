"""Secret scans through a trigram inverted index, with DataFrame functions alone.

From each rule's pattern a Boolean query over trigrams is derived: an AND of clauses, each an OR of
trigram sets that must all occur. The index lists, for each trigram that any query asks for, the
documents that contain it (letter case aside). Intersecting postings gives each rule's candidate
documents, and only those are searched with the rule's pattern; a rule whose pattern forces no trigram
is searched in every document.

A pattern's matches are leftmost and don't overlap, as ``re.finditer`` gives them; matches whose
measured group is too short are dropped afterwards. Spans are (start, end) in code points, end
exclusive. A private key reaches from its BEGIN line through its END line, also where its lines are quoted, indented or
escaped; one without an END line as far as its headers and lines of Base64 go, and the word after them.

Defined results: null texts are empty and have no spans; rows with a null or a repeated identifier are
searched like others (the index only decides where to look, the search is per row); an empty table
gives an empty result; other columns are kept by ``redact`` and ignored otherwise.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh


@dataclass(frozen=True)
class Rule:
    """pattern: for Java and RE2; group: whose length counts, 0 for the whole match; least: that length at least."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    quick: str | None = None  # a pattern without captures that every kept match contains, where the rule scans fully


def _either(word: str) -> str:
    """A pattern for a word in either case; (?i) differs between engines beyond ASCII."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# What a private key is made of. Between two of its lines may stand an escaped line end, quotation marks of a program or of a mail, and indentation.
_KEY = "PRIVATE KEY(?: BLOCK)?-----"
_BREAK = r"[\x20\t\"'+,;]*(?:\\+[nr]|[\r\n])(?:\\+[nrt]|[\x20\t\r\n>|*#\"'+,;])*"
_GAP = r"(?:\\+[nrt]|[\x20\t\r\n>|*#\"'+,;])*"
_HEADER = r"[A-Z][A-Za-z0-9-]{2,30}:\x20[^\r\n\\]{0,200}"
# all up to the END line, whatever it is, but for five hyphens; a key without that line: its headers, runs of 16 Base64 characters and more, and the start of a last line
_BODY = rf"(?:[^-]*(?:-{{1,4}}[^-]+){{0,200}}-----END [A-Z0-9 ]*{_KEY}|(?:{_BREAK}{_HEADER})*(?:{_GAP}[A-Za-z0-9+/=]{{16,}})*(?:{_BREAK}[A-Za-z0-9+/=]+)?)"

# Fixed patterns: the three base kinds, then kinds that this operator adds, after the published forms of keys and tokens.
RULES = (
    Rule("assign", "(" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24, "[0-9a-f]{24}"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", "xox[abeprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("pem", rf"-----BEGIN [A-Z0-9 ]*{_KEY}{_BODY}"),
    Rule("putty", r"PuTTY-User-Key-File-[0-9][A-Za-z0-9+/=:,.()\x20\t\r\n-]*"),
    Rule("temporary", "ASIA[A-Z0-9]+", 0, 20),
    Rule("github_pat", "github_pat_[A-Za-z0-9_]+", 0, 33),
    Rule("gitlab", "gl(?:pat|dt|rt|ptt|ft|soat)-[A-Za-z0-9_-]+", 0, 25),
    Rule("slack_hook", r"hooks\.slack\.com/(?:services|workflows)/[A-Za-z0-9/_-]+", 0, 44),
    Rule("discord_hook", r"discord(?:app)?\.com/api/webhooks/[0-9]+/[A-Za-z0-9_-]+", 0, 60),
    Rule("google", "AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("google_oauth", r"ya29\.[A-Za-z0-9_-]+", 0, 25),
    Rule("google_client", "GOCSPX-[A-Za-z0-9_-]+", 0, 30),
    Rule("stripe", "[prs]k_(?:live|test)_[A-Za-z0-9]+", 0, 24),
    Rule("stripe_hook", "whsec_[A-Za-z0-9+/=]+", 0, 30),
    Rule("square", "sq0(?:atp|csp|idp)-[A-Za-z0-9_-]+", 0, 29),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 60),
    Rule("mailgun", "key-[0-9a-z]+", 0, 36),
    Rule("npm", "npm_[A-Za-z0-9]+", 0, 40),
    Rule("pypi", "pypi-[A-Za-z0-9_-]+", 0, 55),
    Rule("rubygems", "rubygems_[0-9a-f]+", 0, 57),
    Rule("docker", "dckr_pat_[A-Za-z0-9_-]+", 0, 30),
    Rule("digitalocean", "do[opr]_v1_[0-9a-f]+", 0, 70),
    Rule("shopify", "shp(?:at|ca|pa|ss)_[0-9a-fA-F]+", 0, 38),
    Rule("hugging", "hf_[A-Za-z0-9]+", 0, 37),
    Rule("vault", r"hv[bs]\.[A-Za-z0-9_-]+", 0, 28),
    Rule("terraform", r"[A-Za-z0-9]{10,20}\.atlasv1\.[A-Za-z0-9_=-]+", 0, 70, r"\.atlasv1\."),
    Rule("databricks", "dapi[0-9a-f]+", 0, 36),
    Rule("grafana", "glsa_[A-Za-z0-9_]+", 0, 40),
    Rule("newrelic", "NRAK-[A-Z0-9]+", 0, 32),
    Rule("postman", "PMAK-[A-Za-z0-9-]+", 0, 60),
    Rule("linear", "lin_api_[A-Za-z0-9]+", 0, 40),
    Rule("telegram", "[0-9]{6,12}:AA[A-Za-z0-9_-]+", 0, 43, "[0-9]:AA[A-Za-z0-9_-]"),
    Rule("age", "AGE-SECRET-KEY-1[A-Z0-9]+", 0, 60),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("azure", "AccountKey=([A-Za-z0-9+/=]+)", 1, 40),
    Rule("bearer", r"[Bb]earer\x20+([A-Za-z0-9._~+/=-]+)", 1, 20),
    Rule("basic", r"[Bb]asic\x20+([A-Za-z0-9+/=]+)", 1, 20),
    Rule("address", r"[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20/:@\"'<>]+:([^\x00-\x20/:@\"'<>]+)@", 1, 3),
)

#: Strings kept apart while a pattern is read; beyond that their trigrams are settled and reading starts anew.
_MOST = 64

Clause = frozenset  # of frozensets of trigrams: one of them must occur wholly


def _clause(strings: set[str]) -> Clause | None:
    sets = {frozenset(s[i : i + 3].lower() for i in range(len(s) - 2)) for s in strings}
    if frozenset() in sets:
        return None
    return frozenset(s for s in sets if not any(o < s for o in sets))


def trigram_query(pattern: str) -> list[Clause]:
    """Clauses that hold for every text in which the pattern matches; none: the pattern forces no trigram."""
    clauses: list[Clause] = []

    def settle(strings: set[str]) -> None:
        if (c := _clause(strings)) and c not in clauses:
            clauses.append(c)

    def read(items) -> set[str] | None:
        """The exact strings of a sequence, or None after settling what it forces."""
        now: set[str] | None = {""}
        whole = True
        for op, arg in items:
            name, part = str(op), None
            if name == "LITERAL":
                part = {chr(arg).lower()}
            elif name == "IN":
                if all(str(o) == "LITERAL" for o, _ in arg):
                    part = {chr(a).lower() for _, a in arg}
            elif name == "SUBPATTERN":
                part = read(arg[3])
            elif name == "BRANCH":
                found = [exact(branch) for branch in arg[1]]
                part = None if any(x is None for x in found) else set().union(*found)
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, inner = arg
                once = exact(inner)
                if once is not None and int(high) <= 3:
                    part = {"".join(x) for n in range(low, int(high) + 1) for x in product(once, repeat=n)}
                elif low and once is not None:
                    settle({a + b for a in now for b in once})
            elif name == "AT":
                part = {""}
            if part is None or len(now) * len(part) > _MOST:
                settle(now)
                whole, now = False, part if part is not None and len(part) <= _MOST else {""}
            else:
                now = {a + b for a in now for b in part}
        if whole:
            return now
        settle(now)
        return None

    def exact(items) -> set[str] | None:
        """The exact strings of a sequence that need not occur, so nothing is settled by it."""
        held = list(clauses)
        found = read(items)
        clauses[:] = held
        return found

    strings = read(re._parser.parse(pattern))
    if strings is not None:
        settle(strings)
    return clauses


def asked(pattern: str, most: int = 3) -> list[Clause]:
    """The trigram query with ``most`` trigrams of each set, those with the fewest letters first: it holds wherever the whole one does."""
    rare = lambda g: (sum(c.isalpha() for c in g), g)
    return [frozenset(frozenset(sorted(s, key=rare)[:most]) for s in c) for c in trigram_query(pattern)]


def build_index(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(gram, doc_id): postings of the trigrams that the rules ask for."""
    grams = sorted({g for r in rules for c in asked(r.pattern) for s in c for g in s})
    low = docs.select(F.col(id_col).alias("doc_id"), F.lower(text_col).alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return low.select("doc_id", F.explode(present).alias("gram"))


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, kinds): for each document the kinds whose trigram query its postings satisfy."""
    lists = index.groupBy("doc_id").agg(F.collect_set("gram").alias("grams"))

    def holds(clause: Clause) -> Column:
        sets = [F.size(F.array_except(F.array(*[F.lit(g) for g in sorted(s)]), "grams")) == 0 for s in sorted(clause, key=sorted)]
        out = sets[0]
        for x in sets[1:]:
            out = out | x
        return out

    kinds = []
    for r in rules:
        if query := asked(r.pattern):
            test = holds(query[0])
            for c in query[1:]:
                test = test & holds(c)
            kinds.append(F.when(test, F.lit(r.kind)))
    return lists.select("doc_id", F.array_compact(F.array(*kinds)).alias("kinds")).filter(F.size("kinds") > 0)


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule in a text, as array of (start, rank, stop).

    Each step of the search takes the shortest text before the next match, or before the end, so that
    the lengths of these pieces say where the matches are.
    """
    step = F.lit(f"(?s)(.*?)(?:({rule.pattern})|\\z)")
    before, hit = (F.regexp_extract_all(text, step, F.lit(g)) for g in (1, 2))
    measured = F.regexp_extract_all(text, step, F.lit(2 + rule.group)) if rule.group else hit
    pieces = F.arrays_zip(before.alias("before"), hit.alias("hit"), measured.alias("measured"))
    none = F.array().cast("array<struct<start:int,rank:int,stop:int>>")

    def add(held, p):
        start = held["at"] + F.length(p["before"])
        stop = start + F.length(p["hit"])
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(F.length(p["measured"]) >= rule.least, F.concat(held["spans"], one)).otherwise(held["spans"]).alias("spans"))

    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda held: held["spans"])


def find_secrets(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", out: str = "secret_spans") -> DataFrame:
    """docs with one more column, or with that column replaced: (start, rank, stop) by start, then rule; rank is the rule's place."""
    none = F.array().cast("array<struct<start:int,rank:int,stop:int>>")
    own, kinds = fresh(docs, "__id"), fresh(docs, "__kinds")
    held = candidates(build_index(docs, rules, id_col, text_col), rules).select(F.col("doc_id").alias(own), F.col("kinds").alias(kinds))
    rows = docs.join(held.hint("shuffle_hash"), F.col(id_col) == F.col(own), "left")
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = []
    for rank, rule in enumerate(rules):
        if trigram_query(rule.pattern):
            # the index has no say about rows without an identifier
            look = F.when(F.col(id_col).isNull(), True).otherwise(F.coalesce(F.array_contains(kinds, rule.kind), F.lit(False)))
        else:
            look = F.regexp_like(text, F.lit(rule.quick or rule.pattern))
        found.append(F.when(look, _spans(text, rule, rank)).otherwise(none))
    return rows.withColumn(out, F.array_sort(F.concat(*found))).drop(own, kinds)


def redact(docs: DataFrame, rules=RULES, mark: str = "[secret]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span, and what overlapping spans cover together, replaced by a mark; columns as they were."""
    spans = fresh(docs, "secret_spans")
    rows = find_secrets(docs, rules, id_col, text_col, spans)
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(held, s):
        piece = F.concat(held["out"], F.substring(text, held["at"] + 1, s["start"] - held["at"]), F.lit(mark))
        return F.struct(F.greatest(held["at"], s["stop"]).alias("at"), F.when(s["start"] >= held["at"], piece).otherwise(held["out"]).alias("out"))

    # a span that begins inside the one before it extends what that one's mark stands for
    done = F.aggregate(spans, start, cut, lambda held: F.concat(held["out"], F.substring(text, held["at"] + 1, F.length(text))))
    clean = F.when(F.size(spans) > 0, done).otherwise(text)
    return rows.withColumn(text_col, clean).select(*[f"`{c}`" for c in docs.columns])
