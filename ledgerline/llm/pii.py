"""Personal data: patterns, and a skip-chain conditional random field that keeps labels consistent over a document.

The base kinds are patterns with checks. The field adds what patterns alone can't tell: names of people, and the parts and
other spellings of what a pattern found elsewhere in the text (the local part of a mail address by itself, a phone
number without its country, a card number with dots). Its nodes are the base matches, whose labels are given, and the tokens
that could be personal: capitalised words, long numbers, and words of letters and digits or dots. Edges join neighbours
(the chain) and each token with the next one that is equal or similar to it, at whatever distance (the skips): as many edges
as nodes, not all pairs. All nodes of a text get their marginals together, by loopy message passing, so that a name that
one place introduces is known where it stands alone.

The weights are trained here by the gradient of the likelihood, with marginals of the same message passing, on stretches
of at most SAMPLE documents (by hash; WINDOW characters of each, from a place by hash) into which made-up names and
numbers are written at known places, with and without words that announce them; what else the stretches hold counts as
no entity but where a base pattern matches. Labels, languages and sources are no inputs. Everything after the fit is a map over rows: no shuffle, and a task holds a
batch of texts.

Defined results: null texts are empty and have no spans; texts of any length are read whole, in time linear in their length;
spans are (kind, start, stop) in code points, end exclusive, by kind and then start, and added spans don't touch base spans; rows with null or repeated
identifiers are read like others; without documents the model knows base kinds alone; other columns go through unchanged, and one with the
name of the result is replaced by it.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base kinds in their order, then what the field adds: parts and other spellings of these, and people.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "email_part", "ip_part", "card_part", "phone_part", "person")

#: Labels of nodes: none, the base kinds, a person.
LABELS = 6
PERSON = 5

#: Documents whose stretches are fitted at most, characters of a stretch, and turns of the fit.
SAMPLE, WINDOW, TURNS = 400, 3_000, 100

#: Marginal from which a label counts, and rounds of messages.
SURE, ROUNDS = 0.8, 8

#: Nodes whose messages are passed at once.
PART = 60_000

_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, stop) of the base patterns, by kind and start; kinds by number. Linear in the text.

    A run of letters before an at sign is looked at once, from its end; digits are taken as whole runs.
    """
    found, last = [], 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append((0, start, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and _luhn(d):
            found.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            found.append((3, *m.span()))
    return found


_UPPER = "A-ZÀ-ÖØ-ÞΑ-ΩА-Я"
_NUMBER = re.compile(r"[0-9(][0-9]*+[)]?(?:[\x20./-]{0,2}[(]?[0-9]++[)]?)*+")
_DOTTED = re.compile(r"[._][A-Za-z0-9]++(?:[._][A-Za-z0-9]++)*+")
_WORD = re.compile(rf"[{_UPPER}][^\W\d_]++(?:['’-][^\W\d_]++)*+")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LOWER = frozenset("abcdefghijklmnopqrstuvwxyz")

# Words that announce an entity, by kind. Fixed values.
_CUES = {
    "name": "name mr mrs ms miss dr prof dear contact regards sincerely signed nom prénom monsieur madame mme bonjour cher chère cordialement herr frau name gruß grüße señor señora sr sra nombre hola atentamente patient attn",
    "phone": "phone tel telephone mobile cell call fax sms whatsapp téléphone portable telefon handy anrufen teléfono móvil llamar",
    "mail": "email mail e-mail courriel correo mailto account user username login handle konto compte cuenta",
    "card": "card visa mastercard amex credit debit carte karte tarjeta cvv",
    "ip": "ip host server address gateway serveur adresse servidor",
    "other": "order invoice id no number ref ticket version date page commande facture rechnung nummer pedido factura número file datei fichier",
}
#: Cues that a full stop may follow. Fixed values.
_SHORT = frozenset("mr mrs ms dr prof m mme sr sra tel attn".split())
#: Words between a cue and what it announces. Fixed values.
_THIN = frozenset("is was my the of est ist es".split())
_CUE_OF = {w: k for k, words in _CUES.items() for w in words.split()}


@dataclass
class Graph:
    """Nodes of some texts: features (columns of a matrix of ones, by node), given labels (-1: none), and edges by kind."""

    features: list[list[int]]
    given: list[int]
    edges: list[tuple[int, int, int]]  # node, node, kind
    spans: list[tuple[int, int, int]]  # text, start, stop
    labels: list[int]  # what is true, while fitting


#: Kinds of edges: with a space between them, near each other, equal, similar.
BESIDE, NEAR, EQUAL, SIMILAR = range(4)


class Features:
    """Numbers of feature names; grows while fitting, fixed afterwards."""

    def __init__(self) -> None:
        self.of: dict[str, int] = {}
        self.open = True

    def __call__(self, names: list[str]) -> list[int]:
        if self.open:
            return [self.of.setdefault(n, len(self.of)) for n in names]
        return [self.of[n] for n in names if n in self.of]


def _before(text: str, start: int) -> tuple[list[str], str]:
    """Cues among the three words before a place, with their distance, and the last mark before it."""
    left = text[max(0, start - 40) : start]
    line = left.rfind("\n") + 1
    left = left[line - 1 if line else 0 :]
    cues = []
    words = [w for w in left.lower().replace(":", " ").replace(",", " ").split() if w not in _THIN]
    for d, w in enumerate(reversed(words[-3:])):
        w, stop = w.rstrip(".!?"), w[-1] in ".!?"
        if stop and w not in _SHORT:
            break
        if w in _CUE_OF:
            cues.append(f"{_CUE_OF[w]}{d}")
    bare = left.rstrip(" \t")
    return cues, "start" if not bare or bare[-1] in ".!?\n\r|•" else bare[-1] if bare[-1] in ":(#,;\"'" else "in"


def _lower_words(text: str, words: list[str]) -> set[str]:
    """Which of some words also stand in the text in lower case, by themselves or before a comma or full stop."""
    if not words:
        return set()
    held = set(text.split())
    return {w for w in {w.lower() for w in words} if w in held or w + "," in held or w + "." in held}


def _word_char(c: str) -> bool:
    return c.isalnum() or c == "_"


def _tokens(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, kind) of what could be personal: numbers of seven digits and more, handles, capitalised words. Each pattern looks for a character that is rare."""
    found = []
    last = 0
    for m in _DOTTED.finditer(text):
        s, e = m.span()
        while s > last and text[s - 1] in _ALNUM:
            s -= 1
        if s < m.start() and not text[s].isdigit() and (s == 0 or not _word_char(text[s - 1])) and not text[e : e + 1].isalnum():
            found.append((s, e, "handle"))
            last = e
    for m in _NUMBER.finditer(text):
        s, e = m.span()
        before = text[s - 1] if s else " "
        if before in _LOWER:
            if text[s:e].isdigit() and not _word_char(text[e : e + 1] or " "):
                while s > 0 and text[s - 1] in _LOWER:
                    s -= 1
                if s == 0 or not _word_char(text[s - 1]):
                    found.append((s, e, "handle"))
        elif e - s >= 7 and not before.isalnum() and not text[e : e + 1].isalpha():
            if text[s] == "(" and ")" not in text[s:e]:
                s += 1
            if len(_NOT_DIGIT.sub("", text[s:e])) >= 7:
                found.append((s, e, "number"))
    for m in _WORD.finditer(text):
        s, e = m.span()
        if (s == 0 or not _word_char(text[s - 1])) and not _word_char(text[e : e + 1] or " ") and m.group().lower() not in _CUE_OF:
            found.append((s, e, "word"))
    return found


def add_text(graph: Graph, number: int, text: str, features: Features, truth: dict[tuple[int, int], int] | None = None) -> list[tuple[int, int, int]]:
    """Nodes and edges of one text; gives its base spans. truth: labels by start and stop, while fitting."""
    base = base_spans(text)
    found = [(s, e, "base", k) for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    at = end = 0
    for s, e, kind in sorted(_tokens(text)):
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if s >= end and (at == len(taken) or taken[at][0] >= e):
            found.append((s, e, kind, -1))
            end = e
    if not found:
        return base
    found.sort()
    first = len(graph.spans)
    words = [text[s:e] for s, e, kind, _ in found if kind == "word"]
    often = Counter(words)
    low = _lower_words(text, words)
    keys: dict[str, int] = {}
    end, called = None, False
    for i, (s, e, kind, label) in enumerate(found, first):
        token = text[s:e]
        cues, mark = _before(text, s)
        if kind == "base":
            names = [f"base{label}"]
            own = _NOT_DIGIT.sub("", token) if label else token.lower()
            mine = [f"={own}", f"~{own.split('@')[0]}" if not label else f"~{own[-7:]}"]
        elif kind == "number":
            digits = _NOT_DIGIT.sub("", token)
            n = len(digits)
            size = "7" if n < 9 else "9" if n < 12 else "12" if n < 16 else "16" if n < 20 else "20"
            shape = "".join(sorted(set(re.sub(r"[0-9]", "", token)))) or "plain"
            names = [f"number{size}", f"number:{shape}", f"number:{mark}", *[f"number:{c}" for c in cues]]
            if 13 <= n <= 19:
                names.append("number:sum" if _luhn(digits) else "number:no sum")
            mine = [f"={digits}", f"~{digits[-7:]}"]
        elif kind == "handle":
            names = ["handle", f"handle:{mark}", "handle:digits" if any(c.isdigit() for c in token) else "handle:letters", *[f"handle:{c}" for c in cues]]
            mine = [f"={token.lower()}", f"~{token.lower()}"]
        else:
            word = token.lower().removesuffix("'s").removesuffix("’s")
            names = ["word", f"word:{mark}", f"word:{'upper' if token.isupper() else 'title'}", *[f"word:{c}" for c in cues]]
            if word in low:
                names.append("word:also lower")
            if (n := often[token]) > 4:
                names.append("word:10" if n > 9 else "word:5")
            if called and s - end == 1:
                names.append("word:after called")
            if not cues:
                names.append(f"word:{mark} uncalled")
            mine = [f"={word}", f"~{word.removesuffix('s')}"]
        graph.features.append(features(names))
        graph.given.append(label + 1 if kind == "base" else -1)
        graph.spans.append((number, s, e))
        graph.labels.append(label + 1 if kind == "base" else (truth or {}).get((s, e), 0))
        if end is not None and s - end <= 24 and not (s > end and "\n" in text[end:s]):
            graph.edges.append((i - 1, i, BESIDE if s - end < 2 and text[end:s] in ("", " ", "-") else NEAR))
        end, called = e, kind == "word" and "name0" in cues
        joined = set()
        for key, how in zip(mine, (EQUAL, SIMILAR), strict=True):
            j = keys.get(key)
            if j is not None and j != i - 1 and j not in joined:
                graph.edges.append((j, i, how))
                joined.add(j)
            keys[key] = i
    return base


class Field:
    """Weights of features by label, and of edges: two matrices for the chain, two diagonals for the skips."""

    def __init__(self, features: Features) -> None:
        self.features = features
        self.nodes = np.zeros((len(features.of), LABELS))
        self.pairs = np.zeros((4, LABELS, LABELS))

    def _unary(self, graph: Graph) -> np.ndarray:
        counts = np.array([len(f) for f in graph.features])
        flat = np.fromiter((x for f in graph.features for x in f), np.int64, counts.sum())
        u = np.zeros((len(counts), LABELS))
        of = np.repeat(np.arange(len(counts)), counts)
        for k in range(LABELS):
            u[:, k] = np.bincount(of, self.nodes[flat, k], len(counts))
        given = np.array(graph.given)
        fixed = np.flatnonzero(given >= 0)
        u[fixed] = -30.0
        u[fixed, given[fixed]] = 0.0
        return u

    def marginals(self, graph: Graph, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
        """Of nodes, and of edges: sum-product messages along all edges at once, half of each kept from the round before."""
        u = self._unary(graph)
        n, e = len(u), len(graph.edges)
        if not e:
            b = np.exp(u - u.max(1, keepdims=True))
            return b / b.sum(1, keepdims=True), np.zeros((0, LABELS, LABELS))
        left, right, kind = np.array(graph.edges).T
        source, target = np.concatenate([left, right]), np.concatenate([right, left])
        other = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
        along = np.exp(self.pairs)
        groups = [(np.flatnonzero(kind == k), along[k]) for k in range(4)]
        m = np.full((2 * e, LABELS), -np.log(LABELS))
        for r in range(rounds):
            b = self._beliefs(u, m, target, n)
            z = b[source] - m[other]
            z = np.exp(z - z.max(1, keepdims=True))
            new = np.empty_like(z)
            for at, matrix in groups:
                new[at], new[at + e] = z[at] @ matrix, z[at + e] @ matrix.T
            new = np.log(new / new.sum(1, keepdims=True))
            m = new if r == 0 else (m + new) / 2
        b = self._beliefs(u, m, target, n)
        z = b[source] - m[other]
        z = np.exp(z - z.max(1, keepdims=True))
        both = z[:e, :, None] * along[kind] * z[e:, None, :]
        b = np.exp(b - b.max(1, keepdims=True))
        return b / b.sum(1, keepdims=True), both / both.sum((1, 2), keepdims=True)

    @staticmethod
    def _beliefs(u: np.ndarray, m: np.ndarray, target: np.ndarray, n: int) -> np.ndarray:
        b = u.copy()
        for k in range(LABELS):
            b[:, k] += np.bincount(target, m[:, k], n)
        return b

    def fit(self, graph: Graph, turns: int = TURNS, rate: float = 0.15, prior: float = 2.0) -> None:
        """Gradient steps (Adam's) on the likelihood of the labels, with a Gaussian prior."""
        free = np.array(graph.given) < 0
        counts = np.array([len(f) for f in graph.features])
        flat = np.fromiter((x for f in graph.features for x in f), np.int64, counts.sum())
        of = np.repeat(np.arange(len(counts)), counts)
        keep = free[of]
        flat, of = flat[keep], of[keep]
        truth = np.eye(LABELS)[graph.labels]
        left, right, kind = np.array(graph.edges).T if graph.edges else np.zeros((3, 0), int)
        seen = np.zeros_like(self.pairs)
        np.add.at(seen, (kind, np.array(graph.labels)[left], np.array(graph.labels)[right]), 1)
        diagonal = np.eye(LABELS, dtype=bool)
        moments = [np.zeros_like(w) for w in (self.nodes, self.pairs) for _ in range(2)]
        for t in range(1, turns + 1):
            p, both = self.marginals(graph)
            rest = (truth - p)[of]
            g_nodes = np.column_stack([np.bincount(flat, rest[:, k], len(self.nodes)) for k in range(LABELS)]) - self.nodes / prior
            expected = np.zeros_like(self.pairs)
            for k in range(4):
                expected[k] = both[kind == k].sum(0)
            g_pairs = seen - expected - self.pairs / prior
            g_pairs[EQUAL:] *= diagonal  # a skip says only whether labels agree
            for w, g, first, second in ((self.nodes, g_nodes, *moments[:2]), (self.pairs, g_pairs, *moments[2:])):
                first += 0.1 * (g - first)
                second += 0.01 * (g * g - second)
                w += rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)


# Syllables of made-up names. Fixed values.
_SYLLABLES = "an ber cla da el fe gar han is jo ka lin mo nor ola pe qui ros sa tom ul vi wen xa yor zel mar ti ne co".split()


class _Writer:
    """Writes made-up entities into a stretch of text and keeps their places."""

    def __init__(self, text: str, rng: random.Random) -> None:
        self.rng = rng
        self.pieces: list[tuple[float, list[tuple[str, int]]]] = []
        self.words = re.findall(r"\S+\s*", text)

    def name(self) -> str:
        return "".join(self.rng.choices(_SYLLABLES, k=self.rng.randint(2, 3))).capitalize()

    def digits(self, n: int) -> str:
        return "".join(self.rng.choices("0123456789", k=n))

    def put(self, *parts: tuple[str, int], after: float = 0.0) -> float:
        """Parts (text, label) somewhere after a place between 0 and 1; gives the place."""
        at = self.rng.uniform(after, 1)
        self.pieces.append((at, list(parts)))
        return at

    def person(self) -> None:
        rng, first, last = self.rng, self.name(), self.name()
        shapes = [("My name is", 0), ("name:", 0), ("Mr.", 0), ("Mrs.", 0), ("Dr.", 0), ("Dear", 0), ("contact", 0), ("Regards,", 0), ("signed", 0), ("Monsieur", 0), ("Madame", 0), ("Herr", 0), ("Frau", 0), ("Señor", 0), ("Señora", 0), ("nom :", 0), ("patient", 0)]
        at = self.put(rng.choice(shapes), *([(first, PERSON)] if rng.random() < 0.8 else []), (last, PERSON), after=0.0)
        for _ in range(rng.choice([0, 1, 2, 3])):
            at = self.put((rng.choice([first, last]) if rng.random() < 0.8 else last + "'s", PERSON), after=at * rng.random())

    def phone(self) -> None:
        rng = self.rng
        a, b, c = self.digits(3), self.digits(3), self.digits(4)
        shape = rng.choice(["({}) {}-{}", "{}-{}-{}", "{} {} {}", "{}.{}.{}"]).format(a, b, c)
        if rng.random() < 0.5:
            at = self.put((f"+{rng.randint(1, 99)} ({a}) {b}-{c}", 0), after=0.0)
            self.put((shape, 4), after=at * rng.random())
        else:
            at = self.put((rng.choice(["phone", "tel:", "call", "mobile:", "téléphone", "Telefon", "teléfono"]), 0), (shape, 4))
            if rng.random() < 0.5:
                self.put((shape, 4), after=at * rng.random())

    def mail(self) -> None:
        local = f"{self.name().lower()}{self.rng.choice(['.', '_'])}{self.rng.choice([self.digits(2), self.name().lower()])}"
        at = self.put((f"{local}@{self.name().lower()}.example.com", 0))
        for _ in range(self.rng.choice([0, 1, 2])):
            self.put((local, 1), after=at * self.rng.random())

    def card(self) -> None:
        digits = self.digits(15)
        digits += next(c for c in "0123456789" if _luhn(digits + c))
        at = self.put((digits, 0))
        groups = [digits[i : i + 4] for i in range(0, 16, 4)]
        if self.rng.random() < 0.7:
            self.put((self.rng.choice([".", "/"]).join(groups), 3), after=at * self.rng.random())

    def address(self) -> None:
        parts = [str(self.rng.randint(10, 255)) for _ in range(4)]
        at = self.put((".".join(parts), 0))
        if self.rng.random() < 0.7:
            self.put(("-".join(parts), 2), after=at * self.rng.random())

    def nothing(self) -> None:
        """What resembles entities and is none."""
        rng = self.rng
        for _ in range(rng.randint(0, 3)):
            word = self.name()
            for _ in range(rng.randint(1, 4)):
                self.put((rng.choice(["in", "at", "the", "of", ""]), 0), (word, 0))
        if rng.random() < 0.3:
            line = [(f"{self.name()} {self.name()}." if rng.random() < 0.5 else f"{self.name()}.\n", 0)] * rng.randint(3, 40)
            self.put(*line)
        for _ in range(rng.randint(0, 3)):
            number = rng.choice([self.digits(rng.randint(7, 22)), f"20{self.digits(2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{self.digits(3)}.{self.digits(3)}.{self.digits(3)}", f"{self.digits(4)}-{self.digits(4)}", rng.choice([".", "/", "-"]).join(self.digits(4) for _ in range(4))])
            for _ in range(rng.randint(1, 2)):
                self.put((rng.choice(["order", "invoice", "id", "ref", "", "total", "Rechnung"]), 0), (number, 0))
        for _ in range(rng.randint(0, 2)):
            handle = rng.choice([f"file.v{self.digits(1)}", f"{self.name().lower()}.py", f"{self.name().lower()}_{self.name().lower()}", f"v{self.digits(2)}"])
            for _ in range(rng.randint(1, 3)):
                self.put((handle, 0))

    def done(self) -> tuple[str, dict[tuple[int, int], int]]:
        """The text with all pieces, and the labels of their places."""
        out, truth, length = [], {}, 0

        def add(piece: str) -> None:
            nonlocal length
            out.append(piece)
            length += len(piece)

        held, n = sorted(self.pieces, key=lambda p: p[0]), len(self.words)
        at = 0
        for place, parts in held:
            while at < place * n:
                add(self.words[at] if self.words[at][-1:].isspace() else self.words[at] + " ")
                at += 1
            for text, label in parts:
                if text:
                    start = length
                    add(text)
                    if label:
                        truth[start, length] = label
                    add(self.rng.choice([" ", " ", " ", ", ", ". "]) if (text, label) == parts[-1] else " ")
        for word in self.words[at:]:
            add(word)
        return "".join(out), truth


def written(text: str, seed: int) -> tuple[str, dict[tuple[int, int], int]]:
    """A stretch with made-up entities, and their labels by place; a name followed by 's is one token."""
    rng = random.Random(seed)
    writer = _Writer(text, rng)
    for part, chance in ((writer.person, 0.5), (writer.person, 0.2), (writer.phone, 0.35), (writer.mail, 0.35), (writer.card, 0.4), (writer.address, 0.3), (writer.nothing, 0.8)):
        if rng.random() < chance:
            part()
    return writer.done()


def stretches(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, window: int = WINDOW) -> list[str]:
    """What is fitted: a bounded number of documents, by hash of their texts, and of each a bounded stretch from a place by hash."""
    text = F.col(text_col)
    h = F.xxhash64(text)
    some = docs.filter(F.length(text) > 0)
    least = [r["h"] for r in some.select(h.alias("h")).distinct().orderBy("h").limit(sample).collect()]
    start = (1 + F.pmod(h, F.greatest(F.length(text) - window + 1, F.lit(1)))).cast("int")
    rows = some.filter(h.isin(least)).select(h.alias("h"), F.substring(text, start, F.lit(window)).alias("t"))
    return [r["t"] for r in rows.groupBy("h").agg(F.min("t").alias("t")).orderBy("h").collect()]


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Field:
    """The field, fitted to stretches of the documents with made-up entities."""
    features = Features()
    graph = Graph([], [], [], [], [])
    for i, text in enumerate(stretches(docs, text_col, sample)):
        made, truth = written(text, i)
        add_text(graph, i, made, features, truth)
    features.open = False
    field = Field(features)
    if graph.spans:
        field.fit(graph)
    return field


def spans_of(texts: list[str], field: Field, sure: float = SURE) -> list[list[tuple[int, int, int]]]:
    """(kind, start, stop) for each text, kinds by number in KINDS: base spans, and what the field adds; neighbouring names are one span."""
    out: list[list[tuple[int, int, int]]] = []
    graph = Graph([], [], [], [], [])

    def settle() -> None:
        if not graph.spans:
            return
        p = field.marginals(graph)[0]
        best = p[:, 1:].argmax(1) + 1
        added: dict[int, list[list[int]]] = {}
        for i in np.flatnonzero((p[np.arange(len(p)), best] >= sure) & (np.array(graph.given) < 0)):
            t, s, e = graph.spans[i]
            kind = len(BASE) + int(best[i]) - 1
            held = added.setdefault(t, [])
            if held and kind == len(KINDS) - 1 == held[-1][0] and held[-1][3] == i - 1 and s - held[-1][2] <= 1:
                held[-1][2:] = [e, i]
            else:
                held.append([kind, s, e, i])
        for t, more in added.items():
            out[t] += sorted(tuple(m[:3]) for m in more)
        for part in (graph.features, graph.given, graph.edges, graph.spans, graph.labels):
            part.clear()

    for number, text in enumerate(texts):
        out.append([])
        out[number] = add_text(graph, number, text, field.features)
        if len(graph.spans) >= PART:
            settle()
    settle()
    return out


_SPANS = "array<struct<kind:string,start:int,stop:int>>"


def personal_spans(text: Column, field: Field, sure: float = SURE) -> Column:
    """Spans of a text as array of (kind, start, stop)."""

    @F.pandas_udf(_SPANS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = spans_of([t or "" for t in batch], field, sure)
            yield pd.Series([[{"kind": KINDS[k], "start": s, "stop": e} for k, s, e in spans] for spans in found], dtype=object)

    return find(F.coalesce(text, F.lit("")))


def find_personal(docs: DataFrame, field: Field, text_col: str = "text", out: str = "pii_spans") -> DataFrame:
    """docs with one more column: the spans of personal data."""
    return docs.withColumn(out, personal_spans(F.col(text_col), field))


def redact(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """docs with every span, or what overlapping spans cover together, replaced by the first one's kind in brackets; other columns as they were."""

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            made = []
            for text, spans in zip(batch, spans_of([t or "" for t in batch], field), strict=True):
                at, parts = 0, []
                for s, e, k in sorted((s, e, k) for k, s, e in spans):
                    if s >= at:
                        parts += [text[at:s], f"[{KINDS[k]}]"]
                    at = max(at, e)
                made.append("".join([*parts, text[at:]]) if spans else text)
            yield pd.Series(made, dtype=object)

    return docs.withColumn(text_col, clean(F.col(text_col)))
