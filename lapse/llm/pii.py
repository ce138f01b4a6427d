"""Operator 8: personal data by weak supervision.

Candidate spans come from patterns; regex, gazetteer and context labelers vote
on each (for, against, or nothing). Expectation-maximisation over the counts of
vote patterns estimates how far each labeler can be trusted, and its posteriors
train a logistic span classifier, which decides on the candidates of the kinds
beyond the base. Base spans always stay.

The corpus is scanned once; the driver only takes counts by distinct pattern of
votes and features, whose number is bounded by the labelers, not by the input.

A text of any length is scanned whole in its task.
Null text: as empty. Repeated rows: each has its own row. An empty table gives
an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import batches_of, rows_of, texts
from lapse.session import materialize

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "local_phone", "account", "person"]

LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_PHONE = re.compile(r"(?<![\w+.-])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![\w-])")
ACCOUNT = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?!\w)")
PERSON = re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señor|Señora|Sr|Sra)\.?\x20[A-ZÀ-Þ][a-zß-ÿ]+(?:\x20[A-ZÀ-Þ][a-zß-ÿ]+)?")

# Gazetteers of given names, and of the words before a span that speak for its kind or against any.
GIVEN = frozenset((
    "alexander alice amelia andrew ann anna anne anthony barbara benjamin brian carol catherine charles charlotte christine christopher "
    "daniel david deborah dorothy edward elizabeth emily emma george grace helen henry jack jacob james jane jennifer jessica john joseph "
    "karen kevin laura linda margaret mark martin mary matthew michael nancy nicholas olivia oliver patricia paul peter rachel richard "
    "robert ruth samuel sandra sarah sophia stephen susan thomas victoria william "
    "andreas birgit claudia dieter felix frank gabriele hans heike heinz ingrid jan johannes jonas julia jürgen karl katharina klaus lena "
    "lukas manfred maria markus max monika petra sabine sebastian stefan ursula uwe werner wolfgang "
    "alain antoine camille céline claire denis françois françoise henri isabelle jacques jean julien léa louis lucie luc marie mathieu "
    "michel nathalie nicolas olivier philippe pierre sophie sylvie thierry véronique "
    "alejandro ana antonio carlos carmen cristina diego elena enrique fernando francisco gabriel isabel javier jorge josé juan lucía luis "
    "manuel marta miguel pablo pedro pilar rafael ramón rosa sergio sofía teresa jose lucia sofia").split())
CUES = {
    "email": ("mail", "email", "mailto", "contact", "write", "reach", "kontakt", "correo", "courriel", "@"),
    "ip": ("ip", "address", "host", "server", "login", "adresse", "dirección"),
    "card": ("card", "visa", "mastercard", "payment", "credit", "karte", "kreditkarte", "carte", "bancaire", "tarjeta"),
    "phone": ("call", "phone", "tel", "telephone", "mobile", "fax", "contact", "telefon", "handy", "anruf", "téléphone", "portable", "teléfono", "móvil"),
    "account": ("iban", "account", "konto", "bank", "compte", "cuenta", "bankkonto", "banque", "banco"),
    "person": ("name", "by", "dear", "contact", "regards", "von", "par", "por"),
}
CUES["local_phone"] = CUES["phone"]
AGAINST = ("version", "isbn", "order", "no", "page", "example", "fig", "$", "#")
CONTEXT_WORDS = re.compile(r"[^\W\d_]+|[@$#]")
#: Code points before a span that the context labelers read.
CONTEXT = 40
#: Fewer code points than these lie between a counter cue and its span.
NEAR = 8
#: Least score of a span that counts as personal data.
THRESHOLD = 0.5
LABELERS = ["form", "checksum", "gazetteer", "cue", "counter_cue", "alone"]


def digits(match: str) -> str:
    return "".join(c for c in match if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = sum(int(c) for c in number[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in number[-2::-2])
    return total % 10 == 0


def mod97(account: str) -> bool:
    bare = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of a local part, @ and a dotted domain, in time linear in the text."""
    behind, at = 0, text.find("@")
    while at >= 0:
        before = text[behind:at]
        start = behind + len(before.rstrip(LOCAL_PART))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        behind = domain.end() if domain else at + 1
        at = text.find("@", behind)


def _octets(match: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in match.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, by start, then kind."""
    found = [(s, 0, e) for s, e in emails(text)]
    if "." in text:
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if _octets(m[0])]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Base spans, and candidates of the further kinds that overlap none of them."""
    base = base_spans(text)
    more = [(m.start(), k, m.end()) for k, p in ((4, LOCAL_PHONE), (5, ACCOUNT), (6, PERSON)) for m in p.finditer(text)]
    starts, furthest = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max, initial=-1))
    return sorted(base + [x for x in more if furthest[bisect_left(starts, x[2])] <= x[0]])


def votes(text: str, span: tuple[int, int, int]) -> list[int]:
    """A vote of each labeler: 1 for, -1 against, 0 nothing."""
    start, k, end = span
    kind, match = KINDS[k], text[start:end]
    begin = max(0, start - CONTEXT)
    while 0 < begin < start and text[begin - 1].isalnum():  # a word that the context cuts is no cue
        begin += 1
    words = [(m[0], start - begin - m.end()) for m in CONTEXT_WORDS.finditer(text[begin:start].lower())]
    number = digits(match)
    form = {"local_phone": 9 <= len(number) <= 12, "account": 15 <= len(match.replace(" ", "")) <= 34}.get(kind, True)
    check = 0
    if kind == "card":
        check = 1 if luhn(number) and len(set(number)) > 2 else -1
    elif kind == "account":
        check = 1 if mod97(match) else -1
    elif kind == "ip":
        check = -1 if match.startswith(("0.", "127.", "255.")) else 1
    elif kind in ("phone", "local_phone"):
        check = -1 if len(set(number)) <= 2 else 0
    gazetteer = 0
    if kind == "person":
        gazetteer = 1 if any(w.lower() in GIVEN for w in match.split()) else 0
    elif kind == "email":
        gazetteer = 1 if re.search(r"\.(com|org|net|edu|gov|de|fr|es|eu|io)$", match.lower()) else -1
    cue = 1 if any(w in CUES[kind] for w, _ in words) else 0
    counter = -1 if any(w in AGAINST and away < NEAR for w, away in words) else 0
    lone = lambda c: not c or not (c.isalnum() or c in "_-/")
    alone = 1 if lone(text[start - 1 : start]) and lone(text[end : end + 1]) else -1
    return [1 if form else -1, check, gazetteer, cue, counter, alone]


def labelled_candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, found): one row a document with its candidates (start, kind, end, votes as one number, size class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(i: int | None, text: str) -> tuple:
            found = []
            for span in candidates(text):
                pattern = 0
                for v in votes(text, span):
                    pattern = 3 * pattern + v + 1
                found.append({"start": span[0], "kind": span[1], "end": span[2], "votes": pattern, "size": min(3, (span[2] - span[0]) // 10)})
            return i, found

        kind = pa.struct([(n, pa.int32()) for n in ("start", "kind", "end", "votes", "size")])
        yield from batches_of((row(i, t) for i, t in rows_of(batches, "doc_id", "text")), pa.schema([("doc_id", pa.int64()), ("found", pa.list_(kind))]), 2_000)

    return texts(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(
        run, "doc_id long, found array<struct<start:int,kind:int,end:int,votes:int,size:int>>")


def unpack(pattern: int) -> list[int]:
    out = []
    for _ in LABELERS:
        pattern, v = divmod(pattern, 3)
        out.append(v - 1)
    return out[::-1]


def estimate(votes_by_row: np.ndarray, kinds: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior of each row (a pattern of votes with its count) by expectation-maximisation: labelers vote
    independently given the truth, with one reliability each, and the truth has a prior of its own in each kind."""
    n_labelers = votes_by_row.shape[1]
    hit = np.full((n_labelers, 2, 3), 1 / 3)  # P(vote | truth)
    hit[:, 1] = [0.1, 0.3, 0.6]
    hit[:, 0] = [0.5, 0.4, 0.1]
    prior = np.full(len(KINDS), 0.5)
    column = votes_by_row + 1
    for _ in range(rounds):
        log = np.stack([np.log(np.where(t, prior, 1 - prior))[kinds] + sum(np.log(hit[j, t, column[:, j]]) for j in range(n_labelers)) for t in (0, 1)])
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        for j in range(n_labelers):
            for t, share in ((1, post), (0, 1 - post)):
                counts = np.bincount(column[:, j], weights=weight * share, minlength=3) + 5 * [np.array([0.5, 0.4, 0.1]), np.array([0.1, 0.3, 0.6])][t]
                hit[j, t] = counts / counts.sum()
        prior = (np.bincount(kinds, weights=weight * post, minlength=len(KINDS)) + 1) / (np.bincount(kinds, weights=weight, minlength=len(KINDS)) + 2)
    return post


def features(votes_by_row: np.ndarray, kinds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(kinds), 1)), votes_by_row, np.eye(len(KINDS))[kinds], np.eye(4)[sizes]])


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic regression on soft labels, rows weighted by their counts, by gradient descent with a small penalty."""
    w, total = np.zeros(x.shape[1]), max(weight.sum(), 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        w -= x.T @ ((p - y) * weight / total) + 1e-4 * w
    return w


def pattern_scores(found: DataFrame) -> DataFrame:
    """(kind, votes, size, score): the classifier's probability for each distinct pattern in the corpus; at most
    kinds x 3^labelers x sizes rows."""
    counts = found.select(F.explode("found").alias("c")).select("c.kind", "c.votes", "c.size").groupBy("kind", "votes", "size").agg(
        F.count(F.lit(1)).alias("n"))
    rows = [tuple(r) for r in counts.collect()]
    schema = "kind int, votes int, size int, score double"
    if not rows:
        return found.sparkSession.createDataFrame([], schema)
    rows.sort()
    kinds, patterns, sizes, n = (np.array(c) for c in zip(*rows, strict=True))
    table = np.array([unpack(p) for p in patterns.tolist()])
    x = features(table, kinds, sizes)
    w = train(x, estimate(table, kinds, n.astype(float)), n.astype(float))
    score = 1 / (1 + np.exp(-(x @ w)))
    return found.sparkSession.createDataFrame([(*r[:3], float(s)) for r, s in zip(rows, score, strict=True)], schema)


def pii_spans(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, spans): accepted spans (start, kind, end, score) of every document, by start, then kind."""
    found = materialize(labelled_candidates(docs).withColumn("row", F.monotonically_increasing_id()), "op8-candidates")
    scores = F.broadcast(pattern_scores(found))  # bounded by the labelers
    each = found.where(F.size("found") > 0).select("row", F.explode("found").alias("c")).select("row", "c.*")
    kept = each.join(scores, ["kind", "votes", "size"]).where((F.col("kind") < len(BASE)) | (F.col("score") >= threshold))
    own = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "score"))).alias("spans"))
    return found.select("row", "doc_id").join(own, "row", "left").select("doc_id", F.coalesce(
        "spans", F.array().cast("array<struct<start:int,kind:int,end:int,score:double>>")).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """The spans as digests; `personal`: whether the classifier takes one of them, of whatever kind, for personal data."""
    names = F.array(*(F.lit(k) for k in KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    of_kind = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(of_kind(k).alias(f"n_{name}") for k, name in enumerate(BASE)),
        F.sha2(joined(F.filter("spans", lambda x: x["kind"] < len(BASE))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.exists("spans", lambda x: x["score"] >= THRESHOLD).alias("personal"))
