"""Secret scan: fixed patterns, and strings whose bytes a primed compressor cannot explain.

Besides the three base kinds, every long token of letters and digits that stands in a sensitive context (a word such as
``key`` or ``credential`` shortly before it) is a candidate; of NAME=VALUE it is the value, and the name is context.
Its novelty is its marginal cost: the bytes by which
zstandard's output grows when the token is put back between its neighbours, with a dictionary of identifiers as history.
Ordinary words and identifiers cost little since the dictionary or the context has them; random material costs nearly
its entropy and is reported as kind ``novel``. The base spans stay whatever their cost, but are measured alike: each span
comes with its rate, so that a placeholder (``password=changeme-changeme``) can be told from a key.

Each row is scanned whole and alone: no shuffle.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: The base kinds, in the order in which ties are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16}")
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}")
#: A part of a candidate that holds no '=', but for padding at its end.
VALUE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?")
CONTEXT = re.compile(r"key|token|secret|passw|credential|auth|private|bearer|signature|access", re.IGNORECASE | re.ASCII)
BEFORE, AROUND, RATE = 48, 160, 0.6

#: History for the compressor: identifiers and phrases of configuration and code.
IDENTIFIERS = (
    "password passwd secret token api_key apiKey access_key accessKey secret_key secretKey private_key privateKey client_id clientId client_secret "
    "credential credentials authorization Authorization authentication bearer Bearer session cookie username user_name email address account "
    "config configuration settings environment production development staging database connection string host port endpoint region bucket "
    "https://www.example.com/api/v1/ http://localhost:8080/index.html 127.0.0.1 application/json Content-Type function return import export "
    "const static public class private protected default undefined null true false self this print console.log logger info warning error exception "
    "request response header payload signature encrypt decrypt certificate -----BEGIN PRIVATE KEY----- -----END PRIVATE KEY----- "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000-0000-0000-0000-000000000000 the and with for version value name = \" : '"
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, in code points, end exclusive."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if LONG_HEX.search("\n".join([w for w in text.split() if len(w) >= 16])):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    return sorted(found)


def readings(text: str, start: int, end: int) -> list[list[tuple[int, int]]]:
    """What may be the secret in a candidate, most exact first: values between '=', all after the first '=', the whole."""
    whole = (start, end)
    if "=" not in text[start:end]:
        return [[whole]]
    values = [m.span() for m in VALUE.finditer(text, start, end)]
    after = text.index("=", start, end) + 1
    while after < end and text[after] == "=":
        after += 1
    rest = [(after, end)] if CANDIDATE.fullmatch(text[after:end]) else []
    return [g for g in (values, rest, [whole]) if g]


class Novelty:
    """Marginal compressed bytes of a string between its neighbours."""

    def __init__(self):
        import zstandard

        primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.packer = zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False, write_checksum=False)

    def rate(self, text: str, start: int, end: int) -> float:
        """Bytes that ``text[start:end]`` adds to its surroundings' compressed size, for each of its own."""
        before, after = text[max(0, start - AROUND) : start].encode(), text[end : end + AROUND].encode()
        own = text[start:end].encode()
        return (len(self.packer.compress(before + own + after)) - len(self.packer.compress(before + after))) / len(own)

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        if not any(len(w) >= 20 and CANDIDATE.search(w) for w in text.split()):
            return []
        found = []
        for m in CANDIDATE.finditer(text):
            for group in readings(text, *m.span()):
                own = [(s, 3, e) for s, e in group if not any(b[0] < e and s < b[2] for b in base) and CONTEXT.search(text, max(0, s - BEFORE), s) and self.rate(text, s, e) >= RATE]
                if own:
                    found += own
                    break
        return found


def scan(text: str, novelty: Novelty) -> tuple[list, list]:
    """(base spans, all spans) of one text."""
    base = base_spans(text)
    return base, sorted(base + novelty.spans(text, base))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, rates string"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, rates for each row.

    ``rates`` are the spans' marginal compressed bytes for each of their own, in the spans' order. A null text counts as
    empty and has no spans. Repeated rows give equal values; a null id stays null; other columns are ignored; an empty
    table gives an empty result.
    """

    def run(batches):
        novelty = Novelty()
        for b in slices(batches):
            rows = []
            for t in b["text"].to_pylist():
                base, spans = scan(t or "", novelty)
                rates = ",".join(f"{novelty.rate(t, s, e):.2f}" for s, _, e in spans)
                rows.append((*(sum(k == n for _, k, _ in base) for n in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), rates))
            a, c, h, d, s, r = zip(*rows) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(x, pa.int64()) for x in (a, c, h)), *(pa.array(x, pa.string()) for x in (d, s, r))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "rates"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def mask_secrets(docs: DataFrame, text_col: str = "text", mask: str = "<secret>") -> DataFrame:
    """``docs`` with every found span replaced by ``mask``; overlapping spans become one. All columns stay; null texts stay null."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        novelty = Novelty()
        for b in slices(batches):
            texts = []
            for t in b.column(at).to_pylist():
                if t:
                    parts, last = [], 0
                    for s, _, e in scan(t, novelty)[1]:
                        if s >= last:
                            parts += [t[last:s], mask]
                        last = max(last, e)
                    t = "".join(parts) + t[last:]
                texts.append(t)
            cols = list(b.columns)
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, docs.schema)
