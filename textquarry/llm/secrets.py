"""Secret scans: fixed patterns, and strings that a primed compressor finds novel in a sensitive context.

Three fixed patterns give the base spans. Beyond them, a candidate is a run of 20 or more key-like
characters, with a letter and a digit, in the context of a sensitive word: the rest of its statement (and at least
CONTEXT_CHARS of its line), the next lines where the line is left open, the deeper lines of the block it opens, and lines
that are one key-like string. The body of a private key's PEM frame is a context too. Its novelty is its marginal
size: zstandard compresses the surrounding code with and without it, primed with a dictionary of common
identifiers, and the difference in bytes is divided by its length. Other copies of the value, also as a part of a
longer run, are taken out of the surrounding code first, so that a key that stands twice is as novel as one that
stands once. Identifiers and paths cost a fraction of a byte a character; random keys cost at least NOVEL_BYTES. Those are reported
as kind 'novel', without what a base span covers; base spans always stay. A name or path of plain words is no candidate, nor is
a UUID, an ISBN, or a path of words, numbers and versions, however novel. A password of 12 characters or more that stands alone, by
blanks or quotes, and has a letter, a digit and one of the signs !@#$%^&*~? is a candidate too. Runs longer than PIECE are measured in overlapping
pieces and are one span if a piece is novel. A span goes on over the segments that adjoin it (a token's dotted parts, a key
wrapped over lines), and a PEM body is one span.

Spans count code points, end exclusive. Texts are scanned whole. Defined cases: a null text is empty and
has no span; a null id is carried; repeated rows are scanned separately; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.shared import small

KINDS = ("assign", "access", "hex", "novel")
#: The base patterns and their least lengths.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
LEAST = {"assign": 8, "access": 16}

#: Words after which a key-like string counts as being in a sensitive context.
SENSITIVE = (
    "password", "passwd", "passphrase", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key",
    "private_key", "client_key", "credential", "bearer", "authorization", "signing_key", "encryption_key",
)
#: The same for a short word that begins longer ones.
SENSITIVE_WORD = re.compile(r"auth(?![a-z])")
LEAST_CHARS = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: A name or path: words of one case between signs, each with at most two digits at its end; never a key.
NAME = re.compile(r"[/_.=+-]*+(?:(?:[a-z]++|[A-Z]?[a-z]++|[A-Z]++)[0-9]{0,2}+(?:[/_.=+-]++|\Z))++")
#: Strings that look random and are no secrets: identifiers, book numbers; and the parts of paths and numbered names.
BENIGN = re.compile(
    r"[{(]?[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}[)}]?"
    r"|(?i:(?:e?isbn)[-_=]*+(?:1[03][-_=]++)?+)?(?:97[89]-?)?[0-9](?:-?[0-9]){8}-?[0-9Xx]"
)
PATH_PART = re.compile(r"(?:[A-Za-z]?[a-z]+|[A-Z]+)[0-9]{0,4}|v?[0-9]{1,4}")
NUMBER = re.compile(r"[/_=-]++[0-9]{1,4}\Z")
#: A password with signs, alone between blanks, quotes or brackets.
SIGNED = re.compile(r"(?<![^\s\"'`=(\[])[A-Za-z0-9+/_=!@#$%^&*~?-]{12,}(?=[\"'`,;)\]]|\s|\Z)")
SIGNS = frozenset("!@#$%^&*~?")
CONTEXT_CHARS = 48
#: Characters that are measured at once.
PIECE = 512
STATEMENT_END = re.compile(r"\n|[.!?;](?=\s)")
#: The end of a line whose value is on the next lines.
OPEN_LINE = re.compile(r"[:=|>({\[\"'`\\+,][-+0-9]?[ \t\r]{0,30}\Z")
LONE_LINE = re.compile(r"[ \t]*+(?:[-*>#][ \t]++)?[\"'`]?[A-Za-z0-9+/_=.~-]{20,}+[\"'`]?[ \t]*+[\\+,;)\]}]*+[ \t\r]*+")
BLANKS = re.compile(r"[ \t]*")
HEADER_LINE = re.compile(r"[A-Za-z-]+: .*")
PEM_BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----")
PEM_EDGE = re.compile(r"-----(?:BEGIN|END) ")
#: What adjoins a span: a further part of a token, and a further line of a wrapped key (a break may be written as an escape).
NEXT_PART = re.compile(r"[.:~%$][A-Za-z0-9+/_=-]+")
NEXT_LINE = re.compile(r"[\"'`]?[ \t]*+(?:[+,.&]|\\(?![rn]))?+[ \t]*+(?:\r?\n|\\r\\n|\\n)[ \t>#*]*+[\"'`]?([A-Za-z0-9+/_=-]++)(?=[\"'`]?[ \t]*+(?:[+,;.)\]}]|\\(?![rn]))*+[ \t]*+(?:\r?\n|\\r|\\n|\Z))")
#: Least length of a wrapped key's lines but its last.
WRAPPED = 32
AROUND_CHARS = 256
#: Characters in a row that count as a part of a copy of the value.
COPY_CHARS = 12
NOVEL_BYTES = 0.62
MASK = "[SECRET]"

#: Identifiers and phrases that code around secrets commonly has; they prime the compressor.
IDENTIFIERS = """
access_token refresh_token client_secret client_id api_key apiKey apikey secret_key secretKey private_key privateKey
public_key password passwd passphrase username user_name authorization Authorization Bearer Basic credentials credential
token auth_token authToken session_id sessionId csrf_token signing_key encryption_key aws_access_key_id
aws_secret_access_key database_url connection_string DATABASE_URL SECRET_KEY API_KEY ACCESS_KEY config configuration
settings environment environ getenv os.environ process.env export const let var function return import from class def
public static final private protected string String int boolean true false null None True False self this
https://www.example.com/ http://localhost:8080/ /usr/local/bin/ /var/lib/ /etc/ -----BEGIN PRIVATE KEY-----
0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ example placeholder your_api_key_here changeme
xxxxxxxxxxxxxxxxxxxxxxxx 00000000000000000000000000000000 application/json content-type Content-Type
documentation docs/ reference/ guide/ tutorial/ index.html README.md CHANGELOG version release build commit checksum uuid isbn
""".strip()


class Scanner:
    def __init__(self):
        primer = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=9, dict_data=primer, write_content_size=False)

    def size(self, text: str) -> int:
        return len(self.compressor.compress(text.encode("utf-8", "surrogatepass")))

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, place in KINDS, end) of the fixed patterns, in that order."""
        found, low = [], text.lower()
        if any(w in low for w in ASSIGN_WORDS):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(found)

    def novel(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        low = text.lower()
        if len(low) != len(text):  # a few capitals change their length; fold ASCII only, to keep places
            low = "".join(c.lower() if c.isascii() else c for c in text)
        places = sorted({m.end() for w in SENSITIVE if w in low for m in re.finditer(re.escape(w), low)} | ({m.end() for m in SENSITIVE_WORD.finditer(low)} if "auth" in low else set()))
        regions, found, done, m = [(start, stop, True) for start, stop in pem_bodies(text)], [], 0, None
        regions += [(start, stop, False) for start, stop in contexts(text, places)]
        for start, stop, is_pem in sorted(regions):
            at = max(start, done)
            while at < stop:
                if m is None or m.start() < at:
                    m = CANDIDATE.search(text, at)
                if m is None:
                    return found + self.signed(text, regions, base, found)
                if m.start() >= stop:
                    break
                at = done = m.end()
                for a, b in outside(m.start(), m.end(), base):
                    if b - a < (1 if (a, b) == m.span() else LEAST_CHARS) or not self.incompressible(text, a, b):
                        continue
                    end = b if b < m.end() else self.adjoined(text, a, b)
                    if is_pem:
                        end = max(end, start + len(text[start:stop].rstrip(" \t\r\n\\\"'")))
                    found += [(x, 3, y) for x, y in outside(a, end, base) if (x, y) == (a, b) or any(c.isalnum() for c in text[x:y])]
                    if end > at:
                        at = done = end
                        break
        return found + self.signed(text, regions, base, found)

    def signed(self, text: str, regions: list[tuple[int, int, bool]], base: list[tuple[int, int, int]], found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Passwords with signs in the contexts, where no other span is."""
        more, taken, done = [], sorted(base + found), 0
        for start, stop, _ in sorted(regions):
            at = max(start, done)
            while at < stop and (m := SIGNED.search(text, at)) and m.start() < stop:
                at = done = m.end()
                value = m[0]
                if SIGNS.isdisjoint(value) or not any(c.isdigit() for c in value) or outside(*m.span(), taken) != [m.span()]:
                    continue
                if self.incompressible(text, *m.span()):
                    more.append((m.start(), 3, m.end()))
        return more

    def adjoined(self, text: str, start: int, end: int) -> int:
        """Where a novel span ends that begins so: further parts and lines of it belong to it."""
        line = end - start  # length of the last line's part
        while True:
            if m := NEXT_PART.match(text, end):
                line += m.end() - end
                end = m.end()
            elif m := NEXT_LINE.match(text, end):
                part = m[1]
                if len(part) >= LEAST_CHARS and self.incompressible(text, *m.span(1)):
                    line, end = len(part), m.end(1)
                elif line >= WRAPPED and len(part) < line and not (part.isalpha() and (part.islower() or part.isupper() or part.istitle())):
                    return m.end(1)  # the shorter last line
                else:
                    return end
            else:
                return end

    def incompressible(self, text: str, start: int, end: int) -> bool:
        value = text[start:end]
        if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)) or benign(value):
            return False
        if len(value) <= PIECE:
            return self.costly(text, start, end)
        starts = [*range(start, end - PIECE, PIECE // 2), end - PIECE]
        return any(self.costly(text, at, at + PIECE) for at in starts)

    def costly(self, text: str, start: int, end: int) -> bool:
        value = text[start:end]
        # Far enough that a copy which reaches into AROUND_CHARS is seen whole, even where a copy nearer by is taken out.
        reach = AROUND_CHARS + 2 * len(value)
        before = without_copies(text[max(0, start - reach) : start][::-1], value[::-1])[::-1]
        after = without_copies(text[end : end + reach], value)
        return self.size(before + after + value) - self.size(before + after) >= NOVEL_BYTES * len(value)

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        if not text:
            return []
        base = self.base(text)
        return sorted(base + self.novel(text, base))


def benign(value: str) -> bool:
    """Whether a string is a name, perhaps with a number at its end, a path of words, numbers and versions, a UUID or an ISBN."""
    if NAME.fullmatch(NUMBER.sub("", value)) or BENIGN.fullmatch(value):
        return True
    return "/" in value and all(PATH_PART.fullmatch(p) for p in re.split(r"[/_=.-]+", value) if p)


def contexts(text: str, places: list[int]) -> list[tuple[int, int]]:
    """(start, stop) of the text in which the values of sensitive words that end at places may begin."""
    found, line_end, statement_end, covered = [], -1, -1, 0
    for place in places:
        if place > line_end:
            line_end = text.find("\n", place)
            line_end = len(text) if line_end < 0 else line_end
        if place > statement_end:
            m = STATEMENT_END.search(text, place)
            statement_end = m.start() if m else len(text)
        stop = max(statement_end, min(line_end, place + CONTEXT_CHARS))
        if not found or stop > found[-1][1]:
            found.append((place, stop))
        if statement_end == line_end and line_end >= covered:  # once a line; blocks within a block are covered by it
            covered = max(line_end + 1, block_end(text, place, line_end))
            found.append((line_end, covered))
    return [(a, b) for a, b in found if a < b]


def block_end(text: str, place: int, line_end: int) -> int:
    """Where the lines end that belong to the line about place: values of an open line, deeper lines, lone keys."""
    indent = indent_of(text, text.rfind("\n", 0, place) + 1)
    m = OPEN_LINE.search(text[max(place, line_end - 32) : line_end])
    # A quote opens a value only where it is not the end of one.
    opened = m is not None and (m[0][0] not in "\"'`" or text.count(m[0][0], text.rfind("\n", 0, place) + 1, line_end) % 2 == 1)
    stop, at, first = line_end, line_end + 1, True
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        filled = indent_of(text, at)
        if at + filled < end and text[at + filled] != "\r":
            if LONE_LINE.fullmatch(text, at, end) or (opened and filled > indent):
                stop = end
            elif opened and first:
                m = STATEMENT_END.search(text, at)
                return m.start() if m else end
            else:
                return stop
            first = False
        at = end + 1
    return stop


def indent_of(text: str, at: int) -> int:
    """Blanks from a line's start."""
    return BLANKS.match(text, at).end() - at


def pem_bodies(text: str) -> list[tuple[int, int]]:
    """(start, stop) of what private keys' frames hold; without an end, of the lines that look like it."""
    found = []
    for m in PEM_BEGIN.finditer(text) if "PRIVATE KEY" in text else ():
        edge = PEM_EDGE.search(text, m.end())
        if edge and edge[0].endswith("END "):
            found.append((m.end(), edge.start()))
            continue
        stop = m.end()
        for line in re.compile(r"[^\n]*\n?").finditer(text, m.end(), edge.start() if edge else len(text)):
            own = line[0].rstrip("\n")
            if own.strip() and not LONE_LINE.fullmatch(own) and not HEADER_LINE.fullmatch(own):
                break
            stop = line.start() + len(own)
        found.append((m.end(), stop))
    return found


def outside(start: int, end: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of start to end that no base span covers."""
    parts = []
    for s, _, e in base:  # in order of their starts
        if e <= start:
            continue
        if s >= end:
            break
        if s > start:
            parts.append((start, s))
        start = max(start, e)
    return parts + [(start, end)] if start < end else parts


def without_copies(around: str, value: str) -> str:
    """The first AROUND_CHARS of a text, passing over what it has in common with value in COPY_CHARS or more in a row."""
    grams = {value[k : k + COPY_CHARS] for k in range(len(value) - COPY_CHARS + 1)}
    copied = np.zeros(len(around), bool)
    for k in range(len(around) - COPY_CHARS + 1):
        if around[k : k + COPY_CHARS] in grams:
            copied[k : k + COPY_CHARS] = True
    return "".join(c for c, skip in zip(around[: AROUND_CHARS + len(value)], copied) if not skip)[:AROUND_CHARS]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def masked(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """text with MASK in place of every span; overlapping spans are masked together."""
    if not spans:
        return text
    out, at, open_end = [], 0, -1
    for start, _, end in spans:
        if start >= open_end:
            out += [text[at:start], MASK]
            open_end = end
        open_end = max(open_end, end)
        at = open_end
    return "".join(out) + text[at:]


def found_secrets(docs: DataFrame) -> DataFrame:
    """Counts and spans of every row."""
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:3]), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_novel", pa.int64())])

    def run(batches):
        scanner = Scanner()
        for batch in small(batches):
            each = [scanner.spans(t) for t in batch.column(1).to_pylist()]
            counts = [[sum(k == kind for _, k, _ in spans) for spans in each] for kind in range(len(KINDS))]
            base = [hashlib.sha256(joined([x for x in spans if x[1] < 3]).encode()).hexdigest() for spans in each]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *(pa.array(c, pa.int64()) for c in counts[:3]), pa.array(base, pa.string()),
                pa.array([joined(spans) for spans in each], pa.string()), pa.array(counts[3], pa.int64()),
            ], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_novel bigint")


def without_secrets(docs: DataFrame) -> DataFrame:
    """docs with every span masked in text, and n_chars counted anew where it is present; no row is dropped."""
    at = docs.columns.index("text")
    sized = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        scanner = Scanner()
        for batch in small(batches):
            texts = batch.column(at).to_pylist()
            new = [masked(t, scanner.spans(t)) for t in texts]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            if sized is not None:
                counts = [n if a is b else len(b) for n, a, b in zip(batch.column(sized).to_pylist(), texts, new)]
                batch = batch.set_column(sized, batch.schema.field(sized), pa.array(counts, batch.schema.field(sized).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
