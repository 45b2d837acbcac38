"""Secrets in text: fixed patterns, and strings that a primed compressor finds new.

A string in a sensitive context is compressed with zstandard after the compressor was primed
with an identifier dictionary and the text around it. Words, paths and names seen nearby cost a
few bytes; a random key costs nearly its length. Strings that stay incompressible are reported.
"""

from __future__ import annotations

import bisect
import re

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchgrid.llm.common import put

# Fixed patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

#: Words that make what follows a candidate for the compression test.
CONTEXT = re.compile(r"pass(?:word|wd|phrase|code)|pwd|secret|token|api.?key|access.?key|private.?key|credential|bearer|authorization|signature|client.?id|connection.?string", re.I | re.A)
STEMS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "authorization", "signature", "client", "connection")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~$!@%^&*-]{12,}")
#: A private key block: a header, up to 16 fields of a line each, and the lines of the key, also with
#: escaped line ends. Each part takes all it can and gives nothing back, so a start that fails fails once.
_GAP = r"(?:\s|\\[nr])"
PEM = re.compile(
    rf"-----BEGIN [A-Z0-9 ]{{0,40}}PRIVATE KEY(?: BLOCK)?-----{_GAP}*+(?:[A-Za-z-]{{1,20}}+:(?:(?!\\[nr])[^\n]){{0,1000}}+{_GAP}++){{0,16}}+"
    rf"([A-Za-z0-9+/=]{{16,}}+(?:{_GAP}++[A-Za-z0-9+/=]{{16,}}+)*+(?:{_GAP}++[A-Za-z0-9+/=]{{1,64}}+(?={_GAP}*+-----END))?)",
    re.A,
)
LINE_END = re.compile(r"\s|\\[nr]")
#: A long text of 64 symbols compresses by its alphabet alone, so a key block is measured in pieces of this length.
PIECE = 48
#: A candidate starts within so many characters after the context word, on its line or a later one.
REACH = 96
#: Plain words may be new to the compressor too. One is measured where it is given to the context word directly.
PLAIN = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[-_./~+=]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*[-_./~+=]*|[A-Z]?[a-z]+(?:[A-Z][a-z]+)+|[0-9./:_-]+")
GIVEN = re.compile(r"""["'\s]*(?:[:=]+|[-=]>|\bis\b|\bwas\b)["'\s]*""", re.A)
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Marks around a word that say nothing about it.
MARKS = "*!$%^&~@-_.=,"
#: Characters of surrounding text on either side that prime the compressor.
AROUND = 1024
#: Marginal compressed bytes for each character of the candidate, at least.
NOVELTY = 0.85

#: Identifiers of everyday code and configuration, the first dictionary.
IDENTIFIERS = b"""abstract access account action active address admin algorithm alias allow amount api_key app application args
array assert async attribute auth authorization await backup base64 bearer begin binary boolean branch break bucket buffer build
cache call callback cancel case catch certificate change channel char check class clear client client_id client_secret close code
collection column command commit compare component config configuration connect connection constructor const container content
context continue controller cookie copy count create credential cursor database date default define delete deploy description
destroy detail device dict directory disable document domain double download driver dump element email enable encode encrypt end
endpoint engine entity entry environment error event example exception execute exist export expression extends external factory
false field file filter final finally find finish first flag float folder footer format function future generate generic get
global group handle handler hash header height hidden history host hostname http https identifier image implement import include
index info init input insert instance integer interface internal invalid item iterator join json key keyword label language last
layer layout length level library license limit line link list listener load local localhost location lock log logger login long
loop main manager map master match maximum member memory merge message method migration minimum mode model module monitor name
namespace network new next node none note notification null number object offset open operation operator option order origin
output override owner package page parameter parent parse partition password path pattern payload permission pipeline placeholder
plugin pointer policy port position prefix prepare primary print priority private process processor product production profile
program project property protected protocol provider proxy public publish query queue random range read record redirect reference
refresh region register release remote remove render repository request require reset resource response rest result return role
root route router row rule runtime sample save scale schedule schema scope script search secret section security select selector
self send sequence server service session setting setup shared signature simple size socket sort source stack staging start state
static status stop storage store stream string struct style submit subscribe success suffix super switch system table target task
template temporary test text thread throw time timeout timestamp title token tool trace transaction transfer transform translate
tree trigger true tuple type undefined unique unit update upload upper url user username utils valid validate value variable
vector vendor verify version view virtual void volume wait warning watch web webhook while widget width window worker workspace
wrapper write yaml yield your_password_here your_token_here changeme example.com www.example.com application/json text/html
process.env os.environ getenv config.get settings abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 """

SPAN = T.ArrayType(
    T.StructType().add("kind", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType()).add("base", T.BooleanType()).add("novelty", T.DoubleType())
)


def marginal_bytes(candidate: str, before: str, after: str) -> int:
    """Compressed bytes that the candidate adds to its surroundings and the identifiers."""
    primed = zstandard.ZstdCompressionDict(
        IDENTIFIERS + after.encode("utf-8", "surrogatepass") + b"\n" + before.encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT
    )
    c = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(c.compress(candidate.encode("utf-8", "surrogatepass"))) - len(c.compress(b""))


def _base(text: str, low: str) -> list[tuple[int, int, int, bool, float | None]]:
    found = []
    if any(w in low for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), 0, m.end(), True, None) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end(), True, None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), True, None) for m in HEX.finditer(text)]
    return found


def _novel(text: str, low: str, taken: list) -> list[tuple[int, int, int, bool, float | None]]:
    if not any(w in low for w in STEMS):
        return []
    held = _merged([(s[0], s[2]) for s in taken])
    found = []
    for block in PEM.finditer(text):
        s, e = block.span(1)
        body = LINE_END.sub("", block.group(1))
        pieces = [body[i : i + PIECE] for i in range(0, len(body), PIECE)]
        size = sum(marginal_bytes(p, body[max(0, i * PIECE - AROUND) : i * PIECE], body[i * PIECE + len(p) :][:AROUND]) for i, p in enumerate(pieces))
        if size / len(body) >= NOVELTY and not _overlaps(held, s, e):
            found.append((s, 3, e, False, round(size / len(body), 4)))
    held = _merged(held + [(f[0], f[2]) for f in found])
    end, m = 0, None
    for word in CONTEXT.finditer(text):
        at = max(word.end(), end)
        while True:
            if m is None or m.start() < at:
                m = CANDIDATE.search(text, at)
            if m is None:
                return found
            if m.start() > word.end() + REACH:
                break
            s, e = m.span()
            at = end = e
            value = m.group().rstrip(".=,")
            if ADDRESS.fullmatch(value) or _overlaps(held, s, e):
                continue
            if (not value.strip(MARKS) or PLAIN.fullmatch(value.strip(MARKS))) and not GIVEN.fullmatch(text, word.end(), s):
                continue
            share = marginal_bytes(value, text[max(0, s - AROUND) : s], text[e : e + AROUND]) / len(value)
            if share >= NOVELTY:
                found.append((s, 3, s + len(value), False, round(share, 4)))
    return found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order that cover what the spans cover."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def _overlaps(held: list[tuple[int, int]], s: int, e: int) -> bool:
    k = bisect.bisect_left(held, (e, 0)) - 1  # the last that begins before e
    return k >= 0 and held[k][1] > s


def scan(text: str | None) -> list[dict]:
    """All spans of one text by start, then kind as listed; offsets in code points."""
    if not text:
        return []
    low = text.lower()
    base = _base(text, low)
    spans = sorted(base + _novel(text, low, base))
    return [{"kind": KINDS[k], "start": s, "end": e, "base": b, "novelty": n} for s, k, e, b, n in spans]


@F.pandas_udf(SPAN)
def _spans(texts: pd.Series) -> pd.Series:
    return texts.map(scan)


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with the column ``out``: array of (kind, start, end, base, novelty).

    Kinds assign, access and hex are the fixed patterns (base is true); kind novel is what the
    compressor adds where no base span lies, with its marginal bytes per character: every string
    that begins within 96 characters after a context word, over line ends too, is measured, and
    the lines of a private key block as one; only mail addresses aren't, and strings made of plain
    words or short numbers are only where the context word is given them ("secret: ...",
    "passphrase is ..."). Null and empty texts give an empty array; a text is scanned whole, in time linear in its length; a
    column named like ``out`` is replaced; repeated rows are scanned alike.
    """
    return put(docs, {out: _spans(F.coalesce(F.col(text), F.lit("")))})


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
