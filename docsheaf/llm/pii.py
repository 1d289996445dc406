"""Personal data by weak supervision.

Base spans are what four fixed patterns with their checks find.  Beside them stand candidates that
the base patterns miss: numbers that stand next to each other, telephone numbers with other digits
behind, IPv6 addresses, spelled-out mail addresses.  Labelers vote on every base span and every candidate
(+ for personal data, - against it, 0 abstains): the shape with its checks, a gazetteer of prefixes
and endings, words in front, edges, and neighbours.

``fit`` counts the vote patterns of all documents in Spark.  There are at most ``2 * 4 * 3**5`` patterns, so the
driver can run expectation-maximisation on the counts: it estimates, without any label, how
reliable each labeler is for each kind, and how likely each pattern is personal data.  With these soft labels it trains
a logistic classifier over the votes and kinds.  ``detect`` runs that classifier on the candidates; base
spans always stay.

Defined cases: a null text counts as empty and has no span; repeated rows each get a row; an empty
table gives an empty result and a model that accepts nothing; further columns are not read by the query
and kept by the stage.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsheaf.llm.shared import read_documents, whole_text

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("shape", "gazetteer", "context", "edges", "neighbour")
#: A candidate becomes a span when the classifier gives it this probability.
ACCEPT = 0.8
#: Weight, in spans, of all kinds together in the reliabilities of one kind.
POOLED = 10
#: Characters before a span that the context labeler reads, and around it that the neighbour labeler does.
BEFORE, AROUND = 40, 60

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A start inside a run of digits can match only if the run's own start does: the look-behind keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOOSE_PHONE = re.compile(r"(?:\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}|(?<![0-9+(.-])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4})(?![0-9])")
_LOOSE_CARD = re.compile(r"(?<![0-9])(?:[0-9]{16,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])")
_IP6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]{1,63}){1,8}")

# Calling codes with the digits of a national number, mail endings, and words that speak for or against a kind.
_CALLING = {"1": (10, 10), "7": (10, 10), "20": (9, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "39": (9, 11), "40": (9, 9), "41": (9, 9), "43": (10, 13), "44": (10, 10), "45": (8, 8), "46": (7, 10), "47": (8, 8), "48": (9, 9), "49": (10, 11), "52": (10, 10), "54": (10, 11), "55": (10, 11), "61": (9, 9), "81": (9, 10), "82": (8, 11), "86": (11, 11), "90": (10, 10), "91": (10, 10), "351": (9, 9), "353": (7, 9), "358": (6, 11), "420": (9, 9)}
_ENDINGS = frozenset("com net org edu gov mil int info biz io ai app dev me co uk de fr es it nl be ch at pl cz se no dk fi pt ie ru us ca mx br ar au nz jp kr cn in za tr gr ro eu".split())
_FOR = {"email": ("mail", "contact", "correo", "courriel"), "ip": ("ip", "host", "server", "address", "adresse"), "card": ("card", "visa", "carte", "karte", "tarjeta", "payment"), "phone": ("tel", "phone", "call", "fax", "mobile", "appel", "anruf", "llam")}
_AGAINST = ("version", "ver.", "release", "isbn", "sku", "order", "ticket", "section", "id=", "no.", "token", "hash", "build")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if k % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost non-overlapping matches, found from each ``@``, so that runs without one cost nothing."""
    cursor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > cursor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            cursor = found.end()
        at = text.find("@", max(at + 1, cursor))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that the base patterns miss; none touches a base span of its kind."""
    found: list[tuple[str, int, int]] = []
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP6.finditer(text)] if ":" in text else []
        found += [("card", *m.span()) for m in _LOOSE_CARD.finditer(text)]
        found += [("phone", *m.span()) for m in _LOOSE_PHONE.finditer(text)] if "+" in text or "(" in text else []
    low = text.lower() if "(" in text or "[" in text else ""
    if "(at)" in low or "[at]" in low:
        found += [("email", *m.span()) for m in _SPELLED.finditer(text)]
    if not found:
        return found
    taken: dict[str, list[tuple[int, int]]] = {}
    for kind, a, b in base:
        taken.setdefault(kind, []).append((a, b))
    out = []
    for kind, a, b in found:
        spans = taken.get(kind, [])
        k = int(np.searchsorted([s for s, _ in spans], b)) if spans else 0
        if k == 0 or spans[k - 1][1] <= a:
            out.append((kind, a, b))
    return out


def votes(text: str, span: tuple[str, int, int], starts: np.ndarray, ends: np.ndarray) -> str:
    """The vote pattern of a span: its kind and one of ``+0-`` for each labeler."""
    kind, a, b = span
    value = text[a:b]
    digits = "".join(c for c in value if c in "0123456789")
    shape = gazetteer = "0"
    if kind == "card":
        shape = "+" if luhn(digits) else "-"
        gazetteer = "+" if digits[0] in "3456" else "-" if digits[0] in "0789" else "0"
    elif kind == "phone":
        shape = "+" if 8 <= len(digits) <= 15 and value[0] == "+" else "0" if len(digits) == 10 else "-"
        sizes = [_CALLING[digits[:k]] for k in (1, 2, 3) if digits[:k] in _CALLING and _CALLING[digits[:k]][0] <= len(digits) - k <= _CALLING[digits[:k]][1]]
        gazetteer = "+" if value[0] == "+" and sizes else "-" if value[0] == "+" else "0"
    elif kind == "ip":
        parts = value.split(".")
        shape = "+" if len(parts) == 4 or value.count(":") == 7 else "-"
        gazetteer = "0" if ":" in value else "-" if parts[0].lstrip("0") in ("", *map(str, range(224, 256))) else "+"
    else:
        ending = re.split(r"[.\s()\[\]]+", value.rstrip(")]. ").lower())[-1]
        shape = "+" if ending.isalpha() and len(ending) >= 2 else "-"
        gazetteer = "+" if ending in _ENDINGS else "-"
    before = text[max(0, a - BEFORE) : a].lower()
    context = "-" if any(w in before for w in _AGAINST) else "+" if any(re.search(rf"\b{w}", before) for w in _FOR[kind]) else "0"
    left, right = text[a - 1 : a], text[b : b + 1]
    edges = "-" if left.isalnum() or (right.isalnum()) else "+" if not left.strip() and not right.strip() else "0"
    near = int(np.searchsorted(starts, b + AROUND, side="right")) - int(np.searchsorted(ends, a - AROUND, side="left"))
    own = int(((starts < b) & (ends > a)).sum()) if near > 0 else 0
    return kind + ":" + shape + gazetteer + context + edges + ("+" if near - own > 0 else "0")


def labelled(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], list[str]]:
    """Base spans, candidates, and the vote patterns of both in turn; those of base spans end in ``!``."""
    text = text or ""
    base = base_spans(text)
    more = candidates(text, base)
    if not base and not more:
        return base, more, []
    starts = np.sort(np.array([s[1] for s in base + more]))
    ends = np.sort(np.array([s[2] for s in base + more]))
    return base, more, [votes(text, s, starts, ends) + "!" for s in base] + [votes(text, s, starts, ends) for s in more]


@dataclass
class Model:
    """Labeler reliabilities by kind (P of +, 0, - given personal data or not) and the classifier's weights.

    ``probability`` holds what the weights give for the patterns they were fitted on; others are computed when they
    are met, so a model serves documents it has not seen.
    """

    prior: dict[str, float]
    reliability: dict[str, dict[str, dict[str, tuple[float, ...]]]]
    probability: dict[str, float]
    weights: tuple[float, ...] = ()

    def accepts(self, pattern: str) -> bool:
        if pattern not in self.probability:
            self.probability[pattern] = float(chances(pattern_features([pattern])[2], np.array(self.weights))[0]) if self.weights else 0.0
        return self.probability[pattern] >= ACCEPT


def pattern_features(patterns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds and votes of patterns as one-hots, and the classifier's features: kinds, votes by kind, votes."""
    kind = np.eye(len(KINDS))[[KINDS.index(p.split(":")[0]) for p in patterns]]
    seen = np.eye(3)[np.array([["+0-".index(c) for c in p.split(":")[1][: len(LABELERS)]] for p in patterns])]
    n = len(patterns)
    return kind, seen, np.concatenate([kind, np.einsum("pk,plv->pklv", kind, seen).reshape(n, -1), seen.reshape(n, -1)], axis=1)


def chances(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))


def expectation_maximisation(counts: dict[str, int], rounds: int = 50) -> Model:
    """Reliabilities and soft labels from pattern counts, then the classifier.

    Labelers are taken as independent given the truth and the kind.  A kind's reliabilities lean on those of
    all kinds together as on POOLED further spans, so that rare kinds are not estimated from a few.  Base
    spans are personal data by definition: they give the rates for personal data, and the rounds estimate
    the rates for the rest and the share of both, starting from the candidates' majority of votes.  (If
    candidates could move the first rates too, a kind with two informative labelers may swap the
    meaning of its classes.)  One count is added everywhere.
    """
    patterns = sorted(counts)
    if not patterns:
        return Model({}, {}, {})
    weight = np.array([counts[p] for p in patterns], dtype=float)
    kind, seen, features = pattern_features(patterns)
    vote = seen.argmax(axis=2)
    anchored = np.array([p.endswith("!") for p in patterns])
    truth = np.where(anchored, 1.0, 1 / (1 + np.exp(-2.0 * (1 - vote).sum(axis=1))))

    def rates(mass: np.ndarray) -> np.ndarray:
        """P(vote) by kind and labeler, from the spans' mass."""
        own = np.einsum("p,pk,plv->klv", mass, kind, seen)
        pooled = 1 + own.sum(axis=0)
        out = own + POOLED * pooled / pooled.sum(axis=1, keepdims=True)
        return out / out.sum(axis=2, keepdims=True)

    for _ in range(rounds):
        share = (1 + kind.T @ (weight * truth)) / (2 + kind.T @ weight)
        yes, no = rates(weight * anchored), rates(weight * (1 - truth))
        log = kind @ (np.log(share) - np.log1p(-share)) + np.einsum("pk,plv,klv->p", kind, seen, np.log(yes) - np.log(no))
        truth = np.where(anchored, 1.0, 1 / (1 + np.exp(-np.clip(log, -30, 30))))
    weights = logistic(features, truth, weight)
    probability = chances(features, weights)
    reliability = {k: {name: {"yes": tuple(yes[i, j]), "no": tuple(no[i, j])} for j, name in enumerate(LABELERS)} for i, k in enumerate(KINDS)}
    return Model(dict(zip(KINDS, share.tolist(), strict=True)), reliability, dict(zip(patterns, probability.tolist(), strict=True)), tuple(weights.tolist()))


def logistic(features: np.ndarray, truth: np.ndarray, weight: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton's method."""
    beta = np.zeros(features.shape[1])
    for _ in range(rounds):
        p = chances(features, beta)
        gradient = features.T @ (weight * (truth - p)) - penalty * beta
        hessian = (features * (weight * p * (1 - p))[:, None]).T @ features + penalty * np.eye(len(beta))
        beta = beta + np.linalg.solve(hessian, gradient)
    return beta


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column("text"):
            counts.update(labelled(text.as_py())[2])
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pattern", "n"])


def fit(docs: DataFrame) -> Model:
    """The model of all documents; only pattern counts leave the tasks."""
    rows = docs.select("text").mapInArrow(_counted, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return expectation_maximisation({r["pattern"]: r["n"] for r in rows})


def _spans(text: str | None, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and accepted ones."""
    base, more, patterns = labelled(text)
    return base, [s for s, p in zip(more, patterns[len(base) :], strict=True) if model.accepts(p)]


_SPAN = "struct<kind: string, start: int, end: int, base: boolean>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, spans): all spans of every document by kind, then start, base ones marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text"):
                base, more = _spans(text.as_py(), model)
                own = [(KINDS.index(k), a, b, True) for k, a, b in base] + [(KINDS.index(k), a, b, False) for k, a, b in more]
                out.append([{"kind": KINDS[k], "start": a, "end": b, "base": is_base} for k, a, b, is_base in sorted(own)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, _SPAN_TYPE)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, spans array<{_SPAN}>")


def redacted(text: str | None, model: Model) -> str | None:
    """The text with every span replaced by its kind; overlapping spans become the first one's."""
    base, more = _spans(text, model)
    if not base and not more:
        return text
    parts, at = [], 0
    for kind, a, b in sorted(base + more, key=lambda s: (s[1], -s[2])):
        if a >= at:
            parts += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with spans replaced; no row is dropped, and n_chars, where there is one, follows the text."""

    @F.pandas_udf("string")
    def clean(values):
        import pandas as pd

        return pd.Series([redacted(v, model) for v in values], dtype=object)

    out = docs.withColumn(text, clean(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(text).isNotNull(), F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: personal data of all documents."""
    docs = read_documents(spark, sf_dir).select("doc_id", whole_text("text").alias("text"))
    found = detect(docs, fit(docs))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, with their personal data replaced."""
    return redact(docs, fit(docs))
