"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty.

The base patterns find assignments of passwords and tokens, access keys and long runs of hex digits. The method looks at
further strings in a sensitive context: long tokens shortly after a word such as ``secret`` or ``auth``. For each it
measures the marginal compressed size: the bytes that the string adds to its surroundings when zstandard is primed
with a dictionary of common identifiers and the surrounding text. Names, paths and repeated strings add few bytes;
random keys cannot be compressed, and strings that add more than a share of their length are reported, whatever
characters they mix. Candidates are runs of at least 16 letters, digits and ``+/_-``: shorter or punctuated values are
left to the base patterns. A run of words that the dictionary lacks adds as much as a key, and is reported too.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from docfields.llm.common import map_arrow

# Kinds in order, their patterns, the group that counts and its least length.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_LENGTH = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LENGTH = 20
# A run of at least 24 digits; shorter runs would be dropped anyway.
HEX = re.compile(r"[0-9a-f]{24,}")
# One of these stands in every assignment and every sensitive word, in lower case; a text without any needs no search.
ASSIGN_HINTS = ("passw", "secret", "token", "api")
SENSITIVE_HINTS = ("passw", "secret", "token", "key", "auth", "credential", "bearer", "private", "pwd")
# A sensitive word starts behind anything but a letter, or with the capital of a camel-case part.
SENSITIVE = re.compile(
    r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z]))"
    r"(?i:passw|secret|token|api_?key|key|auth|credential|bearer|private|pwd)",
    re.ASCII,
)
# Equal signs belong to a candidate as its padding only; elsewhere they part a name from its value.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
# The rest of the word itself up to a hyphen or underscore, and the sign that makes what stands before it a name.
REST = re.compile(r"[A-Za-z]*[_-]+")
NAMES = re.compile(r"""["']?\x20*[:=]""")

# How far behind a sensitive word a candidate may begin, how much text on either side primes the compressor, and the
# compressed bytes per character from which a candidate counts as incompressible (random hex digits take about 0.55). Of
# a candidate of few different characters, as of digits alone, this share of what random ones must take is enough.
REACH = 64
SURROUNDINGS = 512
NOVELTY = 0.5
NOVELTY_SHARE, NOVELTY_LEAST = 0.9, 0.3
# Short random strings are stored byte by byte, whatever their characters, so that short names are told apart with more to spare.
SHORT = 40
SHORT_NOVELTY = 0.7
# A candidate longer than this is measured in pieces, so that its price stays in proportion.
MEASURED = 4096

# Words and shapes that identifiers are made of.
IDENTIFIERS = (
    "authentication authorization bearer credential certificate private_key public_key access_token refresh_token "
    "client_secret api_key password username session_id request response header content-type application/json "
    "text/html charset=utf-8 https://www.example.com/index.html http://localhost:8080/api/v1/users configuration "
    "environment development production staging database connection postgresql://localhost:5432 mysql mongodb redis "
    "function return import export default class public static void private protected interface abstract string "
    "integer boolean undefined null true false TypeError ValueError RuntimeException getElementById addEventListener "
    "createElement innerHTML toString valueOf hasOwnProperty prototype constructor __init__ __main__ self.assertEqual "
    "0000000000000000 1111111111111111 1234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
    "0123456789abcdef aaaaaaaaaaaaaaaa xxxxxxxxxxxxxxxx ---------------- ================ ________________ "
    "placeholder your_api_key_here changeme example sample_value key_identifier authorization_code keyboard_shortcut "
    "author_information authority token_type tokenizer secretary keyword_arguments private_network_address"
)

# Longer words of prose, code and paths; the dictionary has them in lower case, capitalised and in upper case.
WORDS = (
    "about above access account action active address administrator advanced after algorithm allocation already always amount analysis "
    "another application archive argument article assets attachment attribute available average background backup balance "
    "because before behavior between billing binary branch browser buffer builder bundle business button calculate callback "
    "campaign catalog category center certificates change channel character characteristic check client cluster collection "
    "command comment common communication community company compatible complete component computer condition config "
    "connect connection constant consumer container content context continue control controller convert cookie counter country create "
    "credentials currency current customer dashboard datasource default delete delivery deploy description design "
    "destination detail developer device dialog different digital directory disable discount display distribution document "
    "documentation domain download duplicate dynamic editor education element email employee enable encoding encryption "
    "endpoint engine enterprise entity error event example exception execute experience experiment expire export expression "
    "external factory failure feature feedback field file filter financial folder format found foundation framework frontend "
    "gateway general generate getting global government group handle handler header health helper history hosting identity "
    "image implementation important include index industry information infrastructure initialize input install installation "
    "instance instruction insurance integration interaction internal international internet invalid inventory invoice item "
    "javascript journal keyboard kubernetes language layout legacy level library license listener loader location logging "
    "login machine maintenance manage management manager manifest manual mapping market marketing material maximum "
    "measurement member memory message metadata method metrics middleware migration minimum missing mobile model module "
    "monitor navigation network nginx notification number object office online openssl operation operator option "
    "order organization original other output package packages page parameter parent parser partner password path pattern "
    "payment performance permission personal physical picture pipeline platform plugin policy popular position possible "
    "preference present previous primary priority process processor product profile program progress project projects property "
    "protocol provider proxy public publish purchase python quality quantity query question random reader reason receive "
    "recommendation record redirect reference register registration relationship release remote remove render report "
    "repository require research reservation resolver resource response responsibility result return review router runner "
    "runtime sample schedule scheduler schema science screen script search section security select sender sequence serializer "
    "server service setting settings shared shipping shopping should signature simple single site software solution source "
    "special standard start state statement static station statistics status storage store strategy stream structure student "
    "subject submit subscription success summary support switch system target technology template temporary terminal test "
    "text theme thread through timeout tracking training transaction transfer translation transport trigger understanding "
    "university update upgrade upload usage user utility validate validation value variable vendor version video view virtual "
    "volume warehouse warning website widget window without worker workflow workspace wrapper write "
    "/usr/local/share/ /usr/bin/ /var/log/ /etc/ssl/certs/ /home/ /opt/ /src/main/java/com/ /src/test/ /node_modules/ /lib/python3/site-packages/"
)
DICTIONARY = " ".join((WORDS.upper(), WORDS.title().replace(" ", ""), WORDS, IDENTIFIERS)).encode() + b" "


class Span(NamedTuple):
    """Start and end in code points, end exclusive."""

    start: int
    kind: str
    end: int


def base_spans(text: str, lowered: str) -> list[Span]:
    """The spans of the fixed patterns, leftmost and non-overlapping within each kind; too short ones are dropped."""
    found = []
    if any(hint in lowered for hint in ASSIGN_HINTS):
        found += [Span(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [Span(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    found += [Span(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return found


def _compressed(context: bytes, content: bytes) -> int:
    primer = zstandard.ZstdCompressionDict(DICTIONARY + context, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(level=6, dict_data=primer, write_content_size=False).compress(content))


def novelty(text: str, start: int, end: int) -> float:
    """Marginal compressed bytes per character of ``text[start:end]``, given its surroundings and the identifiers."""
    before, after = text[max(0, start - SURROUNDINGS) : start], text[end : end + SURROUNDINGS]
    context = (before + after).encode("utf-8", "surrogatepass")
    close = text[max(0, start - 16) : start].encode("utf-8", "surrogatepass")
    total = 0
    for at in range(start, end, MEASURED):
        piece = text[at : min(end, at + MEASURED)].encode()
        total += _compressed(context, close + piece) - _compressed(context, close)
    return total / (end - start)


def incompressible(text: str, start: int, end: int) -> bool:
    """Whether ``text[start:end]`` adds more than its share; random characters of k kinds take log2(k) bits each."""
    share = NOVELTY_SHARE * math.log2(len(set(text[start:end]))) / 8
    least = SHORT_NOVELTY if end - start <= SHORT else min(NOVELTY, max(NOVELTY_LEAST, share))
    return novelty(text, start, end) >= least


def novel_spans(text: str, lowered: str, known: list[Span]) -> list[Span]:
    """Incompressible candidates in sensitive context that overlap no known span."""
    if not any(hint in lowered for hint in SENSITIVE_HINTS):
        return []
    found: dict[int, int] = {}
    after = 0
    for word in SENSITIVE.finditer(text):
        if word.end() + REACH <= after:
            continue
        for m in CANDIDATE.finditer(text, max(word.end(), after)):
            start, end = m.span()
            if start > word.end() + REACH:
                break
            after = end
            if start == word.end():
                # The rest of an identifier that holds the sensitive word itself; its last part may be a value.
                rest = REST.match(text, start, end)
                if not rest or NAMES.match(text, end) or not CANDIDATE.fullmatch(text, rest.end(), end):
                    continue
                start = rest.end()
            found[start] = end
    taken = sorted((s.start, s.end) for s in known)
    result, at, reach = [], 0, 0
    for start, end in sorted(found.items()):
        while at < len(taken) and taken[at][0] < end:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= start and incompressible(text, start, end):
            result.append(Span(start, "novel", end))
    return result


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a text, each by start and then in the order of the kinds."""
    if not text:
        return [], []
    lowered = text.lower()
    base = sorted(base_spans(text, lowered), key=lambda s: (s.start, KINDS.index(s.kind)))
    return base, sorted([*base, *novel_spans(text, lowered, base)], key=lambda s: (s.start, KINDS.index(s.kind)))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def find_secrets(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_sha256 and spans (``kind:start:end``, comma-joined) of every row.

    Null and empty texts have no spans. A text may have any length: its patterns are searched in the whole of it and
    candidates are measured against bounded surroundings. Equal texts give equal results; other columns are not
    read; no rows give no rows.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            digests, spans = [], []
            for text in batch.column(1):
                base, every = scan(text.as_py())
                for k in KINDS:
                    counts[k].append(sum(s.kind == k for s in every))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(digests, pa.string()),
                 pa.array(spans, pa.string())],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    return map_arrow(
        documents.select("doc_id", "text"), run,
        f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string",
    )
