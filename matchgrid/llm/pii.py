"""Personal data in text: fixed patterns, and a skip-chain conditional random field.

The mentions of a document (strings shaped like addresses or numbers) are the variables of a
random field. Mentions that match a fixed pattern are observed. The others take their label from
shape and context (node potentials), from the mention before (chain potentials), and from equal
or similar mentions anywhere in the document (skip potentials), by loopy belief propagation: a
number written once as "+1 (559) 555-3817" makes a later "559-555-3817" a phone number.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchgrid.llm.common import put

# Fixed patterns of the base kinds, written so that a failing start is never tried again.
EMAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_NAME = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
PHONE_LABEL = LABELS.index("phone")

#: Strings that may be personal data: shapes only, wider than the fixed patterns.
NUMBER = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}")
AT = re.compile(r"(?<![^\s<(\[\"',;:])[^\s@<>()\[\]\"',;:]++(?:@|\x20?[\[(](?:at|AT)[\])]\x20?)[^\s@<>()\[\]\"',;:]{2,}+(?:\x20?[\[(](?:dot|DOT)[\])]\x20?[^\s@<>()\[\]\"',;:]++)*+")
CUES = {
    "phone": re.compile(r"(?:phone|tel|call|mobile?|cell|fax|fon|whatsapp)\b[^0-9]{0,12}$", re.I),
    "card": re.compile(r"(?:card|visa|mastercard|amex|credit|debit|karte)\b[^0-9]{0,12}$", re.I),
    "ip": re.compile(r"(?:\bip|host|server|addr(?:ess)?|from)\b[^0-9]{0,12}$", re.I),
    "email": re.compile(r"(?:e-?mail|mailto|contact|write)\b[^0-9@]{0,24}$", re.I),
}
FEATURES = ("bias", "at", "dots3", "plus", "paren", "d7_8", "d9_12", "d13_19", "d20", "solid", "spaced", "hyphen", *(f"cue_{k}" for k in CUES))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind as listed, then start."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and EMAIL_NAME.match(text, start - 1):
            start -= 1
        m = EMAIL_HOST.match(text, at) if start < at else None
        if m:
            found.append((0, start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)  # no address contains a second @
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m.group().split(".")):
            found.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((3, *m.span()))
    return found


@dataclass
class Mention:
    start: int
    end: int
    label: int  # 1 to 4 when a fixed pattern says so, else 0
    key: str
    features: list[int]
    alike: str = ""  # what similar mentions have in common
    barred: tuple[int, ...] = ()  # labels that the mention's own shape rules out


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[Mention]:
    """The variables of a document's field in order of position."""
    held = sorted((s, e, k) for k, s, e in base)
    spans, free = [(s, e, k + 1) for s, e, k in held], []
    for pattern in (AT, NUMBER):
        free += [m.span() for m in pattern.finditer(text)] if pattern is NUMBER or "@" in text or "(at)" in text or "[at]" in text else []
    at = 0
    for s, e in sorted(free):
        while at < len(held) and held[at][1] <= s:
            at += 1
        if (at == len(held) or held[at][0] >= e):
            spans.append((s, e, 0))
    out, end = [], -1
    for s, e, k in sorted(spans, key=lambda x: (x[0], -x[2])):
        if k == 0 and s < end:
            continue
        end = max(end, e)
        t = text[s:e]
        digits = re.sub(r"[^0-9]", "", t)
        before = text[max(0, s - 32) : s]
        at_like = "@" in t or "at)" in t.lower() or "at]" in t.lower()
        n = len(digits)
        yes = (True, at_like, t.count(".") == 3 and not at_like, t[0] == "+", "(" in t and not at_like, 7 <= n <= 8, 9 <= n <= 12, 13 <= n <= 19, n > 19, t.isdigit(), " " in t, "-" in t, *(bool(c.search(before)) for c in CUES.values()))
        key = re.sub(r"\s*[\[(]dot[\])]\s*", ".", re.sub(r"\s*[\[(]at[\])]\s*", "@", t.lower())).strip(".-_") if at_like else digits[-9:]
        # of addresses the name, of numbers the end without area codes
        alike = "@" + re.sub(r"[._+-]|[0-9]+$", "", key.partition("@")[0]) if at_like else digits[-7:]
        may = (True, at_like, not at_like and t.count(".") == 3, not at_like and 13 <= n <= 19 and luhn(digits), not at_like and n <= 15)
        out.append(Mention(s, e, k, key, [i for i, y in enumerate(yes) if y], alike, () if k else tuple(i for i, y in enumerate(may) if not y)))
    return _bar_bare_numbers(out)


def _bar_bare_numbers(found: list[Mention]) -> list[Mention]:
    """A number that no pattern caught is no phone unless something in the document speaks for one: a
    plus, a word before it, or a phone of the same or similar digits. Dates, serial and order numbers
    have none of these, and their shapes alone say nothing."""
    phones = {x for m in found if m.label == PHONE_LABEL for x in (m.key, m.alike)}
    plus, cue = FEATURES.index("plus"), FEATURES.index("cue_phone")
    for m in found:
        if not m.label and plus not in m.features and cue not in m.features and m.key not in phones and m.alike not in phones:
            m.barred = tuple(sorted({*m.barred, PHONE_LABEL}))
    return found


def skip_edges(found: list[Mention]) -> list[tuple[int, int, bool]]:
    """(a, b, whether they are equal): each mention with the one before and with the first of the
    same key, and of those alike but for the key: linear in number."""
    edges: dict[tuple[int, int], bool] = {}
    for equal in (True, False):
        first: dict[str, int] = {}
        last: dict[str, int] = {}
        for i, m in enumerate(found):
            key = m.key if equal else m.alike
            if not key or key == "@":
                continue
            if key in last:
                for j in {last[key], first[key]}:
                    if equal or found[j].key != m.key:
                        edges.setdefault((j, i), equal)
            else:
                first[key] = i
            last[key] = i
    return [(a, b, equal) for (a, b), equal in edges.items()]


@dataclass
class Field:
    """Log-potentials: node (features x labels), chain, skip of equal and of similar mentions
    (labels x labels)."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    similar: np.ndarray

    @staticmethod
    def start() -> Field:
        n = len(LABELS)
        node = np.zeros((len(FEATURES), n))
        node[0, 0] = 1.0
        return Field(node, np.zeros((n, n)), np.eye(n) * 1.0, np.eye(n) * 0.5)


def _of_one_kind(found: list[Mention]) -> list[Mention]:
    """The mentions, those equal to a matched one with its label."""
    kinds = {m.key: m.label for m in found if m.label and m.key}
    return [replace(m, label=kinds.get(m.key, 0)) if not m.label else m for m in found]


def fit_field(docs: list[list[Mention]], rounds: int = 400, rate: float = 4.0, ridge: float = 1e-4) -> Field:
    """Pseudo-likelihood: each label given its features and its neighbours' labels.

    The labels are those of the fixed patterns, and a mention equal to a matched one is of its
    kind, whatever it looks like. That no pattern matches says "other" only of mentions that
    nothing ties to personal data: one that is similar to a matched one, or stands behind a cue,
    is left out, so that the field learns more than to repeat the patterns. Of the
    features a mention is scored by, one half of its shape is hidden in turn, so that the skip
    potentials learn to carry labels over.
    """
    cues = set(range(len(FEATURES) - len(CUES), len(FEATURES)))
    field = Field.start()
    n = len(LABELS)
    rows, chain_rows, skip_rows, similar_rows, told, labels = [], [], [], [], [], []
    count = 0
    for found in map(_of_one_kind, docs):
        labels += [m.label for m in found]
        for i, m in enumerate(found):
            for f in m.features:
                rows.append((count + i, f))
            if i:
                chain_rows += [(count + i, found[i - 1].label, 0), (count + i - 1, m.label, 1)]
        known = [bool(m.label) or not cues.intersection(m.features) for m in found]
        for a, b, equal in skip_edges(found):
            (skip_rows if equal else similar_rows).extend([(count + a, found[b].label), (count + b, found[a].label)])
            for i, j in ((a, b), (b, a)):
                known[i] &= bool(found[i].label) or not found[j].label
        told += known
        count += len(found)
    if not count:
        return field
    y = np.array(labels)
    x = np.zeros((count, len(FEATURES)))
    for i, f in rows:
        x[i, f] = 1
    before, after, skip, similar = (np.zeros((count, n)) for _ in range(4))
    weight = np.array(told, float)[:, None] / max(1, sum(told))
    for i, label, side in chain_rows:
        (after if side else before)[i, label] += 1
    for i, label in skip_rows:
        skip[i, label] += told[i]
    for i, label in similar_rows:
        similar[i, label] += told[i]
    target = np.eye(n)[y]
    hide = np.random.default_rng(0)
    for _ in range(rounds):
        seen = x * (hide.random(x.shape) < 0.5)
        seen[:, 0] = 1
        z = seen @ field.node + before @ field.chain + after @ field.chain.T + skip @ field.skip + similar @ field.similar
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (target - p) * weight
        field.node += rate * (seen.T @ g - ridge * field.node)
        field.chain += rate * (before.T @ g + (after.T @ g).T - ridge * field.chain)
        for side, pot in ((skip, field.skip), (similar, field.similar)):
            up = side.T @ g
            pot += rate * ((up + up.T) / 2 - ridge * pot)
    return field


def infer(found: list[Mention], field: Field, sweeps: int = 8) -> np.ndarray:
    """Label marginals of each mention by loopy sum-product, observed mentions clamped."""
    n, k = len(found), len(LABELS)
    unary = np.zeros((n, k))
    for i, m in enumerate(found):
        unary[i] = field.node[m.features].sum(0)
        if m.label:
            unary[i] = -50.0
            unary[i, m.label] = 0.0
        unary[i, list(m.barred)] = -50.0
    edges = [(i, i + 1, 0) for i in range(n - 1)] + [(a, b, 1 if equal else 2) for a, b, equal in skip_edges(found)]
    if edges:
        a = np.array([e[0] for e in edges])
        b = np.array([e[1] for e in edges])
        pot = np.stack([field.chain, field.skip, field.similar])[[e[2] for e in edges]]
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        msg = np.zeros((len(src), k))
        for _ in range(sweeps):
            belief = unary.copy()
            np.add.at(belief, dst, msg)
            z = (belief[src] - msg[back])[:, :, None] + pot
            top = z.max(1)
            new = top + np.log(np.exp(z - top[:, None, :]).sum(1))
            new -= new.max(1, keepdims=True)
            msg = 0.5 * msg + 0.5 * new
        np.add.at(unary, dst, msg)
    p = np.exp(unary - unary.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def scan(text: str | None, field: Field, threshold: float = 0.8) -> list[dict]:
    """All spans of a text, by kind as listed, then start; offsets in code points."""
    if not text:
        return []
    base = base_spans(text)
    spans = [(k, s, e, True, 1.0) for k, s, e in base]
    found = mentions(text, base)
    if any(m.label == 0 for m in found):
        for m, p in zip(found, infer(found, field), strict=True):
            if m.label == 0 and p[1:].max() >= threshold:
                spans.append((int(p[1:].argmax()), m.start, m.end, False, round(float(p[1:].max()), 6)))
    return [{"kind": KINDS[k], "start": s, "end": e, "base": b, "probability": p} for k, s, e, b, p in sorted(spans)]


SPAN = T.ArrayType(
    T.StructType().add("kind", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType()).add("base", T.BooleanType()).add("probability", T.DoubleType())
)
_MENTION = T.ArrayType(T.StructType().add("label", T.IntegerType()).add("key", T.StringType()).add("alike", T.StringType()).add("features", T.ArrayType(T.IntegerType())))
#: The field is fitted on so many documents (those of the smallest id hashes) of so many characters at most.
SAMPLE_DOCS = 2000
SAMPLE_CHARS = 20_000


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Field:
    """The field of a bounded sample, labelled by the fixed patterns.

    It holds ``sample_docs`` documents, whole, of those with digits or an @ and of at most
    ``sample_chars`` characters. Scoring reads everything.
    """

    @F.pandas_udf(_MENTION)
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"label": m.label, "key": m.key, "alike": m.alike, "features": m.features} for m in mentions(t, base_spans(t))])

    some = docs.select(F.xxhash64(doc_id).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    some = some.filter((F.length("t") <= sample_chars) & F.col("t").rlike("[0-9]{4}|@"))
    rows = some.orderBy("h", F.length("t")).limit(sample_docs).select(found("t").alias("m")).collect()
    return fit_field([[Mention(0, 0, m["label"], m["key"], list(m["features"]), m["alike"]) for m in r["m"]] for r in rows if r["m"]])


def find_pii(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", out: str = "pii", field: Field | None = None) -> DataFrame:
    """``docs`` with the column ``out``: array of (kind, start, end, base, probability).

    Spans of the fixed patterns have base true; the field adds mentions that its marginals call
    personal data. Null and empty texts give an empty array; texts are scanned whole, in time
    linear in their length and mentions; a column named like ``out`` is replaced; repeated rows
    are scanned alike; without mentions to learn from the field keeps its starting weights.
    """
    field = field or fit(docs, text, doc_id)

    @F.pandas_udf(SPAN)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: scan(t, field))

    return put(docs, {out: spans(F.coalesce(F.col(text), F.lit("")))})
