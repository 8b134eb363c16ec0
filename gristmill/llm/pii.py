"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Base spans (email, ip, card, phone) follow fixed rules and always stay.  The method adds
spans of kinds that no fixed rule settles: account numbers, social numbers, phone numbers
without an international prefix, passwords and keys, names of persons and addresses.  For
each candidate, labelers vote yes, no or abstain: a strict regex, a gazetteer of contact
words before the span, the context around it, a checksum (or what stands for one: the
variety of a key's characters, a known first name), and a shape test.  Expectation-maximisation estimates every
labeler's reliability from the agreement of votes alone, and its posteriors train a
logistic span classifier over surface features, whose decision is final.

Votes and features are small discrete values, so the driver sees counts of distinct
(kind, votes, features) patterns, at most MAX_PATTERNS of them by construction; all
documents count, none is sampled.

Defined results.  Null and empty texts have no spans.  Very long texts are read whole,
in linear time.  Each row is judged on its own, so null and repeated ids are carried as
they are.  An empty table gives an empty table.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stored, tidy

BASE = ("email", "ip", "card", "phone")
#: Fixed patterns of the base kinds; [0-9]+ runs are entered at their first digit only.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Candidates of the added kinds: wide nets, judged afterwards.
CANDIDATES = (
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("local_phone", re.compile(r"(?<![+0-9A-Za-z.])(?:\([0-9]{2,5}\)|[0-9]{2,5})[ /.-]{1,2}[0-9]{3,4}[ -][0-9]{3,4}(?![0-9A-Za-z])")),
    ("ssn", re.compile(r"(?<![0-9A-Za-z.-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9A-Za-z-])")),
    ("secret", re.compile(r"(?:passw(?:or)?d|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?[ \t]{0,2}[=:][ \t]{0,2}[\"']?([^\s\"',;<>]{6,128})", re.I)),
    ("secret", re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA|ghp_|gho_|glpat-|xox[abp]-|sk-)[A-Za-z0-9_-]{12,80})")),
    ("address", re.compile(r"(?<![0-9A-Za-z])([0-9]{1,5} (?:[A-Z][A-Za-z.'-]{0,20} ){1,4}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Ct|Way|Place|Square|Terrace))(?![A-Za-z])")),
    ("address", re.compile(r"(?<![0-9A-Za-zÄÖÜäöüß])([A-ZÄÖÜ][a-zäöüß]{1,24}(?:straße|strasse|weg|platz|allee|gasse) [0-9]{1,4}[a-z]?)(?![0-9A-Za-z])")),
    ("name", re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora)\.? ([A-ZÀ-Þ][a-zß-ÿ'-]{1,24}(?: [A-ZÀ-Þ][a-zß-ÿ'-]{1,24}){0,2})")),
    ("name", re.compile(r"(?i:name|contact|regards|sincerely|signed|author|patient|customer|mr|mrs)[:,]?[ \t\n]{1,3}([A-ZÀ-Þ][a-zß-ÿ'-]{1,24} [A-ZÀ-Þ][a-zß-ÿ'-]{1,24})(?![A-Za-zß-ÿ])")),
)
KINDS = tuple(dict.fromkeys(k for k, _ in CANDIDATES))
#: A text without any of these holds no candidate that needs no digit.
CUES = re.compile(r"[=:]|[A-Z][a-z]{1,8}\.? [A-ZÀ-Þ]|[,\n]")
STRICT = {
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4})+(?: [A-Z0-9]{1,3})?|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"),
    "local_phone": re.compile(r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}"),
    "ssn": re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"),
    "secret": re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/=_.!@#$%^&*-]{8,}"),
    "address": re.compile(r"[1-9][0-9]{0,4} (?:[A-Z][a-z]+ ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Way|Place|Square|Terrace)|[A-ZÄÖÜ][a-zäöüß]+ [1-9][0-9]{0,3}[a-z]?"),
    "name": re.compile(r"[A-ZÀ-Þ][a-zß-ÿ]{2,}(?: [A-ZÀ-Þ][a-zß-ÿ'-]{2,})+"),
}
GAZETTEER = {
    "iban": frozenset("account iban bank konto kontonummer compte cuenta".split()),
    "local_phone": frozenset("phone tel telephone telefon call mobile fax handy telefono teléfono téléphone portable".split()),
    "ssn": frozenset("ssn social security insurance".split()),
    "secret": frozenset("password passwd pwd passphrase secret token key apikey credentials login bearer".split()),
    "address": frozenset("address lives living home residence street ship deliver mail adresse anschrift wohnt domicilio".split()),
    "name": frozenset("mr mrs ms miss dr prof herr frau monsieur madame mme señor señora name contact regards sincerely signed patient customer".split()),
}
#: First names that are common in several countries.
FIRST_NAMES = frozenset(
    "Aisha Alexander Alice Ana Andrea Andrew Anna Anne Antonio Barbara Carlos Carmen Charles Christian Claire Daniel David Diana Elena Elizabeth Emily Emma Eric Fatima Francisco Frank George Hannah Hans Helen Ivan Jack James Jan Jane Jean Jennifer John Jorge José Joseph Juan Julia Karen Karl Laura Linda Lisa Louis Lucas Luis Luisa Marco Margaret Maria María Marie Mark Martin Mary Michael Miguel Mohamed Monica Nicole Olivia Pablo Patricia Paul Pedro Peter Petra Philip Pierre Rachel Richard Robert Rosa Sarah Simon Sofia Sophie Stefan Susan Thomas Victoria William Wolfgang".split()
)
#: What stands in samples where a secret would stand.
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|your.*|example.*|changeme|password\d{0,3}|none|null|true|false|required|\$?\{.*|%\w+%)$")
AGAINST = frozenset("version page pages chapter section order invoice isbn part no number license lines rows error code".split())
VOTES, MAX_PATTERNS = 5, len(KINDS) * 3**5 * 4 * 2 * 3


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def mod97(account: str) -> bool:
    raw = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1


def votes_of(kind: str, text: str, start: int, end: int) -> str:
    """One character per labeler: + yes, - no, 0 abstains."""
    span, before, after = text[start:end], text[max(0, start - 48) : start], text[end : end + 24]
    near = re.findall(r"\w+", before.lower())[-4:]
    digits = [c for c in span if c.isdigit()]
    regex = "+" if STRICT[kind].fullmatch(span) else "0"
    gazetteer = "+" if GAZETTEER[kind].intersection(near) else "0"
    context = "-" if AGAINST.intersection(near) else "+" if before.rstrip().endswith((":", "=")) else "0"
    checksum = "0"
    if kind == "iban":
        checksum = "+" if mod97(span) else "-"
    elif kind == "ssn":
        checksum = "-" if span[:3] in ("000", "666") or span[0] == "9" else "0"
    elif kind == "secret":
        checksum = "-" if PLACEHOLDER.match(span) else "+" if len(set(span)) >= 7 and len(digits) * 8 >= len(span) else "0"
    elif kind == "name":
        checksum = "+" if span.split()[0] in FIRST_NAMES else "0"
    if kind in ("secret", "address", "name"):
        shape = "-" if len(set(span)) < 5 or (kind == "name" and after[:1] == "(") else "+"
        return regex + gazetteer + context + checksum + shape
    shape = "-" if len(set(digits)) <= 2 or re.match(r"[0-9]", after.lstrip()) or re.search(r"[0-9]\s*$", before) else "+"
    return regex + gazetteer + context + checksum + shape


def features_of(kind: str, text: str, start: int, end: int) -> str:
    span = text[start:end]
    digits = sum(c.isdigit() for c in span)
    size = min(3, digits // 5)
    marks = int(any(c in "()-" for c in span))
    before = 2 if not text[max(0, start - 1) : start].strip() else 1 if text[start - 1] in ":=(\"'" else 0
    return f"{size}{marks}{before}"


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str, str]]:
    """Candidate spans of added kinds, leftmost first, apart from base spans and one another."""
    digit, cue = DIGIT.search(text), CUES.search(text)
    able = lambda kind: digit if kind not in ("secret", "name") else cue
    found = sorted((m.start(m.lastindex or 0), -m.end(m.lastindex or 0), kind) for kind, p in CANDIDATES if able(kind) for m in p.finditer(text))
    used = sorted((a, b) for _, a, b in taken)
    out, free, k = [], 0, 0
    for start, end, kind in found:
        end = -end
        while k < len(used) and used[k][1] <= start:
            k += 1
        if start < free or (k < len(used) and used[k][0] < end):
            continue
        free = end
        out.append((kind, start, end, votes_of(kind, text, start, end), features_of(kind, text, start, end)))
    return out


_BASE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_MORE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.string()), ("features", pa.string())]))


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, more = [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            spans = base_spans(text)
            base.append([dict(zip(("kind", "start", "end"), s)) for s in spans])
            more.append([dict(zip(("kind", "start", "end", "votes", "features"), s)) for s in candidates(text, spans)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, _BASE), pa.array(more, _MORE)], names=["doc_id", "base", "more"])


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Base spans and voted candidates of each document."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        tidy(_finder), "doc_id long, base array<struct<kind:string,start:int,end:int>>, more array<struct<kind:string,start:int,end:int,votes:string,features:string>>"
    )


def reliabilities(patterns: list[tuple[str, str, int]], rounds: int = 50) -> tuple[dict[tuple[str, str], float], np.ndarray, dict[str, float]]:
    """EM over (kind, votes, count): posterior of each pattern, vote likelihoods, priors by kind.

    likelihood[y, labeler, vote] starts by trusting every labeler a little; one coin per
    class and vote, with a count of one added everywhere.
    """
    kinds = sorted({p[0] for p in patterns})
    code = {"-": 0, "0": 1, "+": 2}
    votes = np.array([[code[c] for c in p[1]] for p in patterns]).reshape(-1, VOTES)
    n = np.array([p[2] for p in patterns], float)
    kind = np.array([kinds.index(p[0]) for p in patterns], int)
    like = np.tile(np.array([[0.5, 0.3, 0.2], [0.2, 0.3, 0.5]])[:, None, :], (1, VOTES, 1))
    prior = np.full(len(kinds), 0.5)
    post = np.zeros(len(patterns))
    for _ in range(rounds):
        score = np.log(prior[kind] / (1 - prior[kind])) if len(patterns) else np.zeros(0)
        for j in range(VOTES):
            score = score + np.log(like[1, j, votes[:, j]] / like[0, j, votes[:, j]])
        post = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        for y, weight in ((0, n * (1 - post)), (1, n * post)):
            for j in range(VOTES):
                c = np.bincount(votes[:, j], weight, 3) + np.array([[2, 1, 0.5], [0.5, 1, 2]])[y]
                like[y, j] = c / c.sum()
        prior = (np.bincount(kind, n * post, len(kinds)) + 1) / (np.bincount(kind, n, len(kinds)) + 2)
    return {(p[0], p[1]): float(x) for p, x in zip(patterns, post)}, like, dict(zip(kinds, prior.tolist()))


def design(kind: str, votes: str, features: str) -> list[float]:
    size, marks, before = (int(c) for c in features)
    return [1.0, *(float(kind == k) for k in KINDS), *(float(v == "+") - float(v == "-") for v in votes), float(size), float(marks), float(before == 2), float(before == 1)]


def train(patterns: list[tuple[str, str, str, int]]) -> dict[tuple[str, str, str], bool]:
    """Decision of the span classifier for every pattern (kind, votes, features)."""
    if not patterns:
        return {}
    merged: dict[tuple[str, str], int] = {}
    for kind, votes, _, n in patterns:
        merged[kind, votes] = merged.get((kind, votes), 0) + n
    post, _, _ = reliabilities([(k, v, n) for (k, v), n in sorted(merged.items())])
    x = np.array([design(*p[:3]) for p in patterns])
    y = np.array([post[p[0], p[1]] for p in patterns])
    n = np.array([p[3] for p in patterns], float)
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton steps of ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - y)) + w
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return {tuple(p[:3]): bool(z > 0) for p, z in zip(patterns, x @ w)}


def _judge(keep: dict[tuple[str, str, str], bool]) -> Callable:
    order = {k: i for i, k in enumerate((*BASE, *sorted(KINDS)))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digest, shown = [], []
            for base, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = sorted((order[s["kind"]], s["start"], s["end"], s["kind"]) for s in base)
                every = sorted(own + [(order[s["kind"]], s["start"], s["end"], s["kind"]) for s in more if keep[s["kind"], s["votes"], s["features"]]])
                text = ",".join(f"{k}:{a}:{b}" for _, a, b, k in own)
                for i, column in enumerate(counts):
                    column.append(sum(s[0] == i for s in own))
                digest.append(hashlib.sha256(text.encode()).hexdigest())
                shown.append(",".join(f"{k}:{a}:{b}" for _, a, b, k in every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(shown, pa.string())], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return run


def detect(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base counts, digest of base spans, and all spans with those the method adds."""
    found = stored(find(docs, id_col, text), "pii-spans")
    counted = found.select(F.explode("more").alias("m")).groupBy("m.kind", "m.votes", "m.features").count()
    patterns = sorted((r[0], r[1], r[2], r[3]) for r in counted.limit(MAX_PATTERNS).collect())  # all there can be
    return found.mapInArrow(tidy(_judge(train(patterns))), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
