"""Personal data by weak supervision.

Labelers vote for, against or not at all on candidate spans: patterns (the base definitions and what their checks said), gazetteers (top-level domains,
given names, dialling codes, card networks, key prefixes), context (words of the neighbourhood, for and against) and checks (sums, lengths, mixtures of characters).
Candidates are matches of the base definitions, also those that failed their checks, and of wider patterns. Expectation-maximisation over the counts of
all vote patterns of the corpus estimates how reliable each labeler is for each kind; the expected labels train a
logistic span classifier. Base spans stay as they are; the classifier adds those candidates it is sure of.

What reaches the driver is one count for each combination of kind, votes and shape, whose number is fixed.

Base definitions (fixed values, leftmost and non-overlapping for each kind, failing matches dropped): see ``base_spans``.
Defined results: a null text is an empty one and has no spans; equal starts are ordered by kind; very long texts cost time in proportion to their length; repeated
rows stay; an empty table gives an empty one; other columns are not carried.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret", "person")
LABELERS = ("pattern", "gazetteer", "context", "check")
#: Probability from which a candidate beyond the base ones is added.
SURE = 0.9

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

OBFUSCATED = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?(?:\(at\)|\[at\]|\sat\s)\s?[A-Za-z0-9-]{1,63}\s?(?:\(dot\)|\[dot\]|\sdot\s)\s?[A-Za-z]{2,12}")
LOCAL_PHONE = re.compile(r"(?<![\w.+-])\(?[0-9]{2,5}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,5}(?![\w-]|\.[0-9])")
SECRET = re.compile(r"(?<![A-Za-z0-9])(?:[A-Fa-f0-9]{32,128}|(?:AKIA|ghp_|sk-)[A-Za-z0-9]{16,64})(?![A-Za-z0-9])")
PERSON = re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? [A-ZÀ-Þ][a-zß-ÿ]{2,20}(?: [A-ZÀ-Þ][a-zß-ÿ]{2,20})?")

#: Given names, top-level domains, dialling codes, prefixes of card networks with their numbers of digits, prefixes of keys, networks of no one's.
NAMES = frozenset("adam alan alex alice amelia amy ana andrea andrew angela anna anne anthony antonio barbara ben bernd bob brian carl carla carlos carmen caroline catherine charles charlotte chris christian christine claire claude clara daniel david diana diego edward elena elisabeth elizabeth emily emma eric eva fernando florian francisco frank franz gabriel george greta hans heinz helen henri henry hugo ines isabel jack jacques james jan jane javier jean jennifer jens jessica joan john jorge jose joseph juan julia julie karen karl karin kate katrin kevin klaus kurt lara laura lea leon lisa louis lucas lucia luis luisa manuel marc marco maria marie marina mark markus marta martin mary matthew max michael miguel monica nicole nina olga oliver pablo patricia patrick paul paula pedro peter philip pierre rachel rafael robert rosa ruth samuel sandra sara sarah sofia sophie stefan stephen steven susan thomas tim tom ursula uwe vera victor walter werner william wolfgang yvonne".split())
DOMAINS = frozenset("com org net edu gov int info biz io co ai app dev eu uk us ca au nz ie de at ch fr be nl lu es pt it pl cz sk hu ro bg gr tr se no dk fi ee lv lt ru ua br mx ar cl pe in cn jp kr tw sg hk id th za ng ke eg il sa ae".split())
DIALLING = tuple("1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 7 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 234 254 351 352 353 354 355 356 357 358 359 370 371 372 380 385 386 420 421 852 880 886 961 962 963 964 965 966 971 972 973 974".split())
CARDS = {"4": (13, 16, 19), "5": (16,), "2": (16,), "34": (15,), "37": (15,), "35": (16,), "30": (14,), "36": (14, 16), "38": (14,), "6": (16, 17, 18, 19)}
KEYS = ("AKIA", "ghp_", "sk-", "xox", "AIza", "eyJ")
NOWHERE = ("0.", "255.", "224.", "240.")
#: Words near a span that speak for personal data of its kind, and words that speak against it.
NEARBY = {
    "email": ("mail", "contact", "write to", "correo", "courriel", "kontakt", "reply"),
    "ip": ("ip", "server", "host", "address", "login", "adresse", "client", "from"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "payment", "mastercard", "debit"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "contact", "whatsapp", "handy", "móvil", "teléfono", "appel"),
    "secret": ("token", "key", "secret", "password", "passwd", "api", "auth", "bearer", "credential"),
    "person": ("name", "contact", "author", "signed", "dear", "patient", "born", "address", "caller"),
}
AGAINST = {
    "email": ("example of", "pattern", "regex"),
    "ip": ("version", "release", "section", "chapter", "build"),
    "card": ("isbn", "order", "serial", "tracking", "invoice", "article", "ean", "iban"),
    "phone": ("isbn", "serial", "order", "version", "page", "pages", "invoice", "score"),
    "secret": ("sha", "md5", "commit", "checksum", "digest", "hash", "color", "colour"),
    "person": ("street", "avenue", "university", "institute", "bridge", "prize"),
}
#: A vote: nothing to say, for, against.
NONE, YES, NO = 0, 1, 2


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def emails(text: str):
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each @ so that long runs cost no more than their length."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the base definitions, and of matches that failed their check."""
    good, bad = [], []
    good += [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        fine = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))
        (good if fine else bad).append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() < 14:
            continue
        digits = re.sub("[^0-9]", "", m[0])
        if len(digits) >= 14:
            (good if len(digits) <= 19 and luhn(digits) else bad).append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            n = sum(c.isdigit() for c in m[0])
            (good if 10 <= n <= 15 else bad).append((m.start(), 3, m.end()))
    return sorted(good), bad


def more_candidates(text: str) -> list[tuple[int, int, int]]:
    out = []
    if "at" in text and "dot" in text:
        out += [(m.start(), 0, m.end()) for m in OBFUSCATED.finditer(text)]
    out += [(m.start(), 3, m.end()) for m in LOCAL_PHONE.finditer(text)] if HAS_DIGITS.search(text) else []
    out += [(m.start(), 4, m.end()) for m in SECRET.finditer(text)] if LONG_RUN.search(text) else []
    out += [(m.start(), 5, m.end()) for m in PERSON.finditer(text)]
    return out


HAS_DIGITS, LONG_RUN = re.compile("[0-9]{3}"), re.compile("[A-Za-z0-9]{16}")


def known(kind: str, span: str, digits: str) -> int:
    """The gazetteer's vote."""
    if kind == "email":
        return YES if re.split(r"[.\s)\]]+", span)[-1].lower() in DOMAINS else NO
    if kind == "ip":
        return NO if span.startswith(NOWHERE) else NONE
    if kind == "card":
        return YES if any(digits.startswith(p) and len(digits) in n for p, n in CARDS.items()) else NO
    if kind == "phone":
        if span.startswith("+"):
            return YES if digits.startswith(DIALLING) else NO
        return YES if digits.startswith("0") or span.startswith("(") else NONE
    if kind == "secret":
        return YES if span.startswith(KEYS) else NONE
    return YES if any(p.lower() in NAMES for p in re.findall(r"\w+", span)) else NONE


def checked(kind: str, span: str, digits: str, fine: bool | None) -> int:
    """The vote of sums, lengths and mixtures of characters."""
    if kind == "card":
        return YES if luhn(digits[:40]) and 13 <= len(digits) <= 19 else NO
    if kind == "phone":
        return YES if 10 <= len(digits) <= 15 else NO if len(digits) < 9 else NONE
    if kind == "ip":
        return YES if fine else NO
    if kind == "secret":
        return YES if len(set(span)) >= 10 and 0 < len(digits) < len(span) else NO
    if kind == "person":
        return YES if span.count(" ") >= 2 else NONE
    return YES if "@" in span else NONE


def votes(text: str, start: int, kind: int, end: int, fine: bool | None) -> int:
    """Votes of the labelers, a digit to the base of three each, and above them three bits of shape: digits, separators, length. fine: what the base pattern's check said, if it matched."""
    name, span = KINDS[kind], text[start:end]
    digits = re.sub("[^0-9]", "", span)
    around = text[max(0, start - 40) : start].lower() + " " + text[end : end + 20].lower()
    context = YES if any(w in around for w in NEARBY[name]) else NO if any(w in around for w in AGAINST[name]) else NONE
    shape = (len(digits) * 2 > len(span)) | (any(c in " -().[]" for c in span) << 1) | ((end - start > 20) << 2)
    pattern = NONE if fine is None else YES if fine else NO
    return pattern + 3 * known(name, span, digits) + 9 * context + 27 * checked(name, span, digits, fine) + 81 * shape


def candidates(text: str) -> list[tuple[int, int, int, bool, int]]:
    """(start, kind, end, base, votes) of everything that a labeler proposes; what overlaps a base span isn't proposed again."""
    good, bad = base_spans(text)
    out = [(a, k, b, True, votes(text, a, k, b, True)) for a, k, b in good]
    begins, ends = [a for a, _, _ in good], list(accumulate((b for _, _, b in good), max))
    for fine, some in ((None, more_candidates(text)), (False, bad)):
        for a, k, b in some:
            before = bisect_left(begins, b)  # base spans that begin before the end of this one
            if not before or ends[before - 1] <= a:
                out.append((a, k, b, False, votes(text, a, k, b, fine)))
    return out


def expect(counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Probability of each vote pattern being personal data, for one kind, by EM from a majority vote. counts: by pattern of the labelers' digits."""
    n = len(LABELERS)
    vote = (np.arange(3**n)[:, None] // 3 ** np.arange(n)) % 3
    said = (vote[:, :, None] == np.arange(3)).astype(float)
    balance = (vote == YES).sum(axis=1) - (vote == NO).sum(axis=1)
    p = 1 / (1 + np.exp(-1.5 * balance.astype(float)))
    # pseudo-counts (nothing, for, against): labelers tend to be right until the corpus says otherwise
    of_yes, of_no = np.array([4.0, 8.0, 1.0]), np.array([4.0, 1.0, 8.0])
    for _ in range(rounds):
        yes, no = counts * p, counts * (1 - p)
        a = np.einsum("v,vlk->lk", yes, said) + of_yes
        b = np.einsum("v,vlk->lk", no, said) + of_no
        ratio = np.log(a / a.sum(axis=1, keepdims=True)) - np.log(b / b.sum(axis=1, keepdims=True))
        prior = (yes.sum() + 1) / (counts.sum() + 2)
        odds = np.log(prior / (1 - prior)) + np.einsum("vlk,lk->v", said, ratio)
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p


def model(patterns: dict[tuple[int, int], int]) -> np.ndarray:
    """Probability by kind and votes-and-shape of the span classifier, a logistic model of votes for, votes against and shape, trained on the expected labels."""
    n, shapes = len(LABELERS), 8
    size = 3**n
    code = np.arange(shapes * size)
    vote, bits = (code[:, None] // 3 ** np.arange(n)) % 3, (code[:, None] // size >> np.arange(3)) & 1
    x = np.concatenate([np.ones((len(code), 1)), vote == YES, vote == NO, bits], axis=1).astype(float)
    out = np.zeros((len(KINDS), len(code)))
    for kind in range(len(KINDS)):
        counts = np.zeros(len(code))
        for (of, v), c in patterns.items():
            if of == kind:
                counts[v] += c
        target = expect(counts.reshape(shapes, size).sum(axis=0))[code % size]
        w, weight = np.zeros(x.shape[1]), counts / max(1.0, counts.sum())
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            s = weight * p * (1 - p)
            w -= np.linalg.solve((x * s[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (weight * (p - target)) + 1e-3 * w)
        out[kind] = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, found) of every row: found is (start, kind, end, base, votes) of its candidates. A null text is empty."""

    def run(batches):
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            found = [[dict(zip(("start", "kind", "end", "base", "votes"), c)) for c in candidates(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32())])))], ["doc_id", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, found array<struct<start:int,kind:int,end:int,base:boolean,votes:int>>")


def label(found: DataFrame) -> DataFrame:
    """``found`` with only base spans and those that the classifier, trained on all of ``found``, is sure of; in order of start and kind."""
    counted = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes").count().collect()
    probability = model({(r[0], r[1]): r[2] for r in counted})
    sure = [int(k) * 1000 + int(v) for k, v in zip(*np.nonzero(probability >= SURE))]
    accepted = F.array(*map(F.lit, sure)) if sure else F.array().cast("array<int>")
    keep = F.filter("found", lambda c: c["base"] | F.array_contains(accepted, c["kind"] * 1000 + c["votes"]))
    return found.withColumn("found", F.array_sort(keep))


def report(labelled: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans)."""
    names = F.array(*map(F.lit, KINDS))
    base = F.filter("found", lambda c: c["base"])
    written = lambda spans: F.concat_ws(",", F.transform(spans, lambda c: F.concat_ws(":", F.element_at(names, c["kind"] + 1), c["start"].cast("string"), c["end"].cast("string"))))
    of_kind = lambda k: F.size(F.filter(base, lambda c: c["kind"] == k))  # noqa: E731  (a second parameter would be the index)
    counts = [of_kind(k).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return labelled.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_spans"))
