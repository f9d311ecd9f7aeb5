"""Personal data by weak supervision.

Wide patterns propose spans.  Labelers vote on each: a strict pattern, a checksum or range test, a
gazetteer of prefixes and endings, cue words before the span, and the span's own shape.
Votes are counted over the whole corpus, expectation-maximisation estimates how reliable
each labeler is for each kind, and its posterior trains a logistic span classifier.  The
classifier adds spans to those of the strict patterns, which always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foldwise.llm.common import byte_slices, kept_table

# The strict patterns, in the order in which spans of equal start are listed.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
# Wider patterns for further spans; the group, if there is one, is the span.
WIDE = {
    "phone": re.compile(r"(?<![0-9A-Za-z+.])(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-][0-9]{2,4}){2,3}(?![0-9A-Za-z])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "secret": re.compile(r"(?i)(?:password|passwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?((?!=)(?:[A-Za-z0-9_\-+/=]|\.(?=[A-Za-z0-9_\-+/=])){8,})"),
}
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
LABELERS = ("pattern", "checksum", "gazetteer", "context", "shape")
CUES = {
    "email": "mail contact contacto courriel adresse kontakt write",
    "ip": "ip host server address adresse login",
    "card": "card visa mastercard karte carte tarjeta credit payment",
    "phone": "phone tel call telefon téléphone teléfono mobile fax",
    "iban": "iban account konto compte cuenta bank",
    "ssn": "ssn social security",
    "secret": "password passwd token secret key",
}
AGAINST = "version isbn issn page figure table section order item serial build rev"
CARD_STARTS = tuple("34 37 4 51 52 53 54 55 6011 65 35".split())
LEFT = 40  # characters before a span in which cue words count
ADD_FROM = 0.9  # least probability of an added span
ROUNDS = 50


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def passes(kind: str, span: str) -> bool:
    """The range and checksum tests of the strict patterns."""
    if kind == "ip":
        parts = [p.lstrip("0") for p in span.split(".")]
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)
    digits = digits_of(span)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind."""
    return sorted(((a, b, k) for a, b, k, ok in _matches(text) if ok), key=lambda s: (s[0], KINDS.index(s[2])))


# The strict patterns in linear time: an address starts with its run of digits, since a match ends with its own.
IP_AT_RUN = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From every @ leftwards to the end of the last match, then the domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        local = at - done - len(text[done:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if local else None
        if domain:
            yield at - local, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def _matches(text: str) -> list[tuple[int, int, str, bool]]:
    """All matches of the strict patterns, and whether they pass."""
    found = []
    if "@" in text:
        found += [(start, end, "email", True) for start, end in _emails(text)]
    if DIGIT.search(text):
        for kind in ("ip", "card", "phone"):
            if kind != "phone" or "+" in text:
                pattern = IP_AT_RUN if kind == "ip" else BASE[kind]
                found += [(m.start(), m.end(), kind, passes(kind, m.group())) for m in pattern.finditer(text)]
    return found


DIGIT = re.compile("[0-9]")


def _iban_ok(span: str) -> bool:
    turned = span.replace(" ", "")
    turned = turned[4:] + turned[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def votes(text: str, start: int, end: int, kind: str, strict: bool) -> tuple[int, ...]:
    """One vote per labeler: 1 for, -1 against, 0 for no opinion."""
    span, digits = text[start:end], digits_of(text[start:end])
    pattern = 1 if strict else 0
    if kind in ("ip", "card", "phone"):
        checksum = 1 if passes(kind, span) else -1
    elif kind == "iban":
        checksum = 1 if _iban_ok(span) else -1
    else:
        checksum = (1 if span[:3] not in ("000", "666") and span[0] != "9" else -1) if kind == "ssn" else 0
    if kind == "card":
        gazetteer = 1 if digits.startswith(CARD_STARTS) else -1
    elif kind == "email":
        gazetteer = 1 if 2 <= len(span.rpartition(".")[2]) <= 6 and span.rpartition(".")[2].isalpha() else -1
    elif kind == "ip":
        gazetteer = -1 if digits.startswith("0") else 0
    else:
        gazetteer = 1 if kind == "phone" and span.startswith("+") else 0
    near = re.findall(r"[^\W\d_]+", text[max(0, start - LEFT) : start].lower())
    context = 1 if any(w in CUES[kind].split() for w in near) else -1 if any(w in AGAINST.split() for w in near) else 0
    plain = len(set(digits)) <= 2 and len(digits) > 4
    varied = len(set(span)) >= 8 and any(c.isalpha() for c in span) and any(c.isdigit() for c in span)
    shape = -1 if plain else (1 if varied else -1) if kind == "secret" else 0
    return pattern, checksum, gazetteer, context, shape


def surroundings(text: str, start: int, end: int) -> tuple[int, int, int]:
    """Classes of the letters at both sides, and of the number of digits."""

    def kind_of(c: str) -> int:
        return 0 if not c else 1 if c.isspace() else 2 if c.isalnum() else 3

    return kind_of(text[start - 1 : start]), kind_of(text[end : end + 1]), min(3, len(digits_of(text[start:end])) // 6)


def candidates(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, int]]]:
    """Spans that stay, and all proposed spans with the number of their vote and surroundings."""
    found = _matches(text)
    base = sorted(((a, b, k) for a, b, k, ok in found if ok), key=lambda s: (s[0], KINDS.index(s[2])))
    spans = {(a, b, k): ok for a, b, k, ok in found if ok or k == "ip" or (k == "card" and 13 <= len(digits_of(text[a:b])) <= 19)}
    if DIGIT.search(text):
        for kind in ("phone", "iban", "ssn"):
            for m in WIDE[kind].finditer(text):
                spans.setdefault((m.start(), m.end(), kind), False)
    if "=" in text or ":" in text:
        for m in WIDE["secret"].finditer(text):
            spans.setdefault((m.start(1), m.end(1), "secret"), False)
    return base, [(a, b, k, code(k, votes(text, a, b, k, ok), surroundings(text, a, b))) for (a, b, k), ok in sorted(spans.items())]


def code(kind: str, ballot: tuple[int, ...], around: tuple[int, int, int]) -> int:
    """One number for kind, votes and surroundings; there are 7 * 3**5 * 4**3 of them."""
    number = KINDS.index(kind)
    for v in ballot:
        number = number * 3 + v + 1
    for a in around:
        number = number * 4 + a
    return number


def uncode(number: int) -> tuple[int, list[int], list[int]]:
    around = [number >> shift & 3 for shift in (4, 2, 0)]
    number >>= 6
    ballot = []
    for _ in LABELERS:
        number, v = divmod(number, 3)
        ballot.insert(0, v - 1)
    return number, ballot, around


def reliabilities(ballots: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each ballot, and the table (class, labeler, vote) of vote probabilities, by
    expectation-maximisation from the majority of the votes."""
    posterior = 1 / (1 + np.exp(-2.0 * ballots.sum(axis=1)))
    table = np.full((2, len(LABELERS), 3), 1 / 3)
    for _ in range(ROUNDS):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        for j in range(len(LABELERS)):
            for v in (-1, 0, 1):
                table[:, j, v + 1] = weight[:, ballots[:, j] == v].sum(axis=1) + (1.0 + (v == 1) * np.array([0, 1]) + (v == -1) * np.array([1, 0]))
            table[:, j] /= table[:, j].sum(axis=1, keepdims=True)
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        odds = np.log(prior / (1 - prior)) + sum(np.log(table[1, j, ballots[:, j] + 1] / table[0, j, ballots[:, j] + 1]) for j in range(len(LABELERS)))
        posterior = 1 / (1 + np.exp(-odds))
    return posterior, table


def fit_classifier(patterns: list[tuple[int, int]]) -> dict[int, float]:
    """Probability of every seen code, from (code, count) pairs of the whole corpus."""
    if not patterns:
        return {}
    numbers, counts = np.array([p for p, _ in patterns]), np.array([n for _, n in patterns], float)
    parts = [uncode(int(p)) for p in numbers]
    kinds, ballots, around = np.array([p[0] for p in parts]), np.array([p[1] for p in parts]), np.array([p[2] for p in parts])
    target = np.zeros(len(numbers))
    for k in np.unique(kinds):
        target[kinds == k], _ = reliabilities(ballots[kinds == k], counts[kinds == k])
    columns = [np.eye(len(KINDS))[kinds]] + [np.eye(3)[ballots[:, j] + 1] for j in range(len(LABELERS))] + [np.eye(4)[around[:, j]] for j in range(3)]
    features = np.concatenate(columns, axis=1)
    share, beta = np.sqrt(counts) / np.sqrt(counts).sum(), np.zeros(features.shape[1])
    for _ in range(200):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-features @ beta))
        gradient = features.T @ (share * (target - p)) - 1e-4 * beta
        hessian = (features * (share * p * (1 - p))[:, None]).T @ features + 1e-4 * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta += step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(numbers.tolist(), (1 / (1 + np.exp(-features @ beta))).tolist()))


def merged(base: list[tuple[int, int, str]], proposed: list[tuple[int, int, str, int]], chance: dict[int, float]) -> list[tuple[int, int, str]]:
    """Base spans and the added ones that overlap none of them nor each other, the likelier first.

    Of a secret, what spans before it leave free is added.
    """
    chosen = list(base)
    starts, ends = [], []  # of what is taken, apart from each other and in order
    for x, y, _ in sorted(base):
        if ends and x < ends[-1]:
            ends[-1] = max(ends[-1], y)
        else:
            starts.append(x)
            ends.append(y)

    def take(a: int, b: int, kind: str) -> None:
        at = bisect_right(ends, a)
        starts.insert(at, a)
        ends.insert(at, b)
        chosen.append((a, b, kind))

    for p, a, b, kind in sorted((-chance.get(n, 0.0), a, b, k) for a, b, k, n in proposed):
        if -p < ADD_FROM:
            break
        at = bisect_right(ends, a)
        over = []
        while at < len(starts) and starts[at] < b:
            over.append((starts[at], ends[at]))
            at += 1
            if kind != "secret":
                break
        if kind != "secret" and over:
            continue
        for x, y in over:
            if a < x:
                take(a, x, kind)
            a = max(a, y)
        if a < b:
            take(a, b, kind)
    return sorted(chosen, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("code", pa.int64())]))


def propose(docs: DataFrame) -> DataFrame:
    """(doc_id, base, proposed): spans in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                kept, wide = [], []
                for text in batch.column("text").to_pylist():
                    base, more = candidates(text or "")
                    kept.append([{"start": a, "end": b, "kind": k, "code": 0} for a, b, k in base])
                    wide.append([{"start": a, "end": b, "kind": k, "code": n} for a, b, k, n in more])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, SPAN), pa.array(wide, SPAN)], ["doc_id", "base", "proposed"])

    span = "array<struct<start:long,end:long,kind:string,code:long>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, base {span}, proposed {span}")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, base (spans of the strict patterns), spans (base and added ones),
    as arrays of (start, end, kind), and spans_text, base_text: kind:start:end, joined by commas.

    Null and empty texts have no spans.  Rows that repeat are answered alike.
    """
    rows = kept_table(propose(docs))
    counted = rows.select(F.explode("proposed").alias("s")).groupBy("s.code").count()
    chance = fit_classifier([tuple(r) for r in counted.orderBy("code").collect()])  # at most 108,864 codes exist

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = [[(s["start"], s["end"], s["kind"]) for s in x] for x in batch.column("base").to_pylist()]
            wide = [[(s["start"], s["end"], s["kind"], s["code"]) for s in x] for x in batch.column("proposed").to_pylist()]
            spans = [merged(a, b, chance) for a, b in zip(base, wide)]
            listed = [pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in x] for x in group], PLAIN) for group in (base, spans)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *listed, pa.array(map(joined, base), pa.string()), pa.array(map(joined, spans), pa.string())],
                ["doc_id", "base", "spans", "base_text", "spans_text"],
            )

    span = "array<struct<start:long,end:long,kind:string>>"
    return rows.mapInArrow(run, f"doc_id long, base {span}, spans {span}, base_text string, spans_text string")


PLAIN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
