"""Secret scan: fixed patterns, and strings that a primed zstandard model finds new.

A candidate is a long run of key characters that stands close behind a sensitive
word. Its novelty is the number of bytes that it adds to the compressed size of
its surroundings, other occurrences of it blanked out and case folded, the compressor being primed
with a dictionary: the words that names in the standard library are made of, and code idioms. Words, identifiers and repetitive
strings cost few bytes. What random characters of the string's own alphabet cost at least is the measure, so that long keys of few characters
count as those of many do; keys that cost clearly more than that are reported wherever they stand in the text.

Defined cases: null text is empty and has no spans; every row gives one row,
repeated or not; texts are scanned whole; spans count code points, end exclusive.
"""

from __future__ import annotations

import builtins
import hashlib
import importlib
import keyword
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import long_ids, read_table, whole_texts

# The base patterns and the lengths that they need.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LEAST = 18
HEX_LEAST = 16
KINDS = ("assign", "access", "hex", "novel")

#: Words that make their surroundings sensitive.
SENSITIVE = "password passwd pwd secret token apikey api_key api-key access_key access-key private_key private-key client_secret credential credentials authorization bearer signature auth_key"
#: What code and configuration usually say: the compressor knows these from the start.
IDENTIFIERS = (
    "def class return import from self None True False const let var function public private static void string int "
    "username user_name email address account config settings environment production development staging localhost "
    "http https www com org net example index value default description version example_key your_api_key_here changeme "
    "access_key_id secret_access_key client_id client_secret refresh_token access_token id_token session_id request_id "
    "password_hash password_reset_token authorization_header content_type application/json charset utf-8 max_length "
    "the and that with this from have were which their there would about other ing tion ment able ness ity ate ous "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 aaaaaaaaaaaaaaaa 0000000000000000 xxxxxxxxxxxxxxxx"
)
#: Modules of the standard library whose names, cut into words, make the dictionary.
MODULES = (
    "http.client http.server http.cookies urllib.request urllib.parse email.message socket ssl logging.config logging.handlers json configparser argparse sqlite3 threading subprocess tempfile pathlib shutil "
    "zipfile tarfile hashlib hmac secrets base64 datetime decimal random statistics itertools functools collections inspect unittest xml.dom.minidom ftplib smtplib imaplib xmlrpc.client wsgiref.handlers "
    "concurrent.futures contextlib dataclasses typing ast pickle gettext locale mailbox mimetypes netrc poplib queue selectors signal socketserver string textwrap traceback types uuid weakref webbrowser"
)
CONTEXT = 48
SURROUNDINGS = 160
NOVEL_LEAST = 20
#: Bytes that a candidate must add beyond what its characters cost at least, if each of the letters, digits and signs that it draws from were as
#: likely as any other: this share of that cost, EXTRA at the most. Short strings are stored as they are, long ones coded nearly at that cost.
NOVELTY, EXTRA = 0.3, 15
LEVEL = 12


@lru_cache(maxsize=1)
def vocabulary() -> str:
    """Words of the names in MODULES, in lower case, in order: the same in every worker of one Python version."""
    names = set(keyword.kwlist) | set(dir(builtins))
    for module in MODULES.split():
        for name, value in vars(importlib.import_module(module)).items():
            names |= {name, *vars(value)} if isinstance(value, type) else {name}
    return " ".join(sorted({w.lower() for n in names for w in re.findall("[A-Z]+(?![a-z])|[A-Z]?[a-z]+", n) if len(w) > 3}))


def bytes_a_character(own: str) -> float:
    """What a character of the string's alphabet costs if all are as likely: digits, letters up to f or all, cases folded, and the signs that occur."""
    used = set(own.lower())
    letters = 0 if not any(map(str.isalpha, used)) else 6 if all(c in "abcdef" for c in used if c.isalpha()) else 26
    size = letters + 10 * any(map(str.isdigit, used)) + sum(not c.isalnum() for c in used)
    return math.log2(max(size, 2)) / 8


class Scanner:
    def __init__(self, sensitive: str = SENSITIVE, identifiers: str | None = None, novelty: float = NOVELTY, extra: float = EXTRA):
        import zstandard

        identifiers = f"{vocabulary()} {IDENTIFIERS}" if identifiers is None else identifiers

        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
        self.access = re.compile(ACCESS)
        self.hex = re.compile("[0-9a-f]{%d,}" % HEX_LEAST)  # longest runs only, as [0-9a-f]+ finds them
        self.run = re.compile("[A-Za-z0-9+/_.-]{%d,}={0,2}" % NOVEL_LEAST)  # a sign of equality stands in front or pads the end
        self.near = re.compile("|".join(map(re.escape, sensitive.split())), re.IGNORECASE | re.ASCII)
        self.novelty, self.extra = novelty, extra
        primed = zstandard.ZstdCompressionDict(identifiers.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=LEVEL)
        self.pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False).compress

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind number, end), by start and kind."""
        spans = [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if m.end() - m.start(2) >= ASSIGN_LEAST]
        spans += [(m.start(), 1, m.end()) for m in self.access.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
        spans += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        return sorted(spans)

    def marginal(self, text: str, start: int, end: int) -> float:
        """Bytes that the candidate adds to its surroundings, per byte of its own."""
        own = text[start:end]
        # other occurrences, also those that reach over the edge, would make the string look known
        blank, reach = " " * len(own), SURROUNDINGS + len(own) - 1
        before = text[max(0, start - reach) : start].replace(own, blank)[-SURROUNDINGS:]
        after = text[end : end + reach].replace(own, blank)[:SURROUNDINGS]
        around = before.lower().encode("utf-8", "replace"), after.lower().encode("utf-8", "replace")
        return (len(self.pack(around[0] + own.lower().encode() + around[1])) - len(self.pack(around[0] + around[1]))) / len(own)

    def novel(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Every occurrence of a string that is found novel in one place, wherever the others stand."""
        starts, ends = [], []  # the base spans, merged: in order and apart
        for start, _, end in base:
            if ends and start <= ends[-1]:
                ends[-1] = max(ends[-1], end)
            else:
                starts.append(start)
                ends.append(end)

        def free(start: int, end: int) -> bool:
            k = bisect_left(starts, end)
            return not k or ends[k - 1] <= start

        keys, known = [], set()
        for m in self.run.finditer(text):
            start, end = m.span()
            own = m.group()
            if own in known or not self.near.search(text, max(0, start - CONTEXT), start) or not free(start, end):
                continue
            least = bytes_a_character(own) * len(own)
            if self.marginal(text, start, end) * len(own) >= least + min(self.novelty * least, self.extra):
                keys.append(own)
                known.add(own)
        if not keys:
            return []
        every = re.compile("|".join(map(re.escape, sorted(keys, key=len, reverse=True))))
        return [(m.start(), 3, m.end()) for m in every.finditer(text) if free(m.start(), m.end())]

    def __call__(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        base = self.base(text)
        return base, sorted(base + self.novel(text, base))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(documents: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_assign, n_access, n_hex, n_novel, base, spans (kind:start:end, comma-joined), redacted text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = Scanner()
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                base, spans = scan(text)
                rows.append((doc, *(sum(k == kind for _, k, _ in spans) for kind in range(4)), joined(base), joined(spans)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base", "spans"])

    return long_ids(whole_texts(documents).mapInPandas(run, "doc_id string, n_assign long, n_access long, n_hex long, n_novel long, base string, spans string"))


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """The text with every span, or run of overlapping spans, replaced by the mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(documents: DataFrame) -> DataFrame:
    """The same rows and columns, with secrets in `text` replaced. A null text becomes empty."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scan = Scanner()
        for t in texts:
            yield t.map(lambda x: redact(x, scan(x)[1]))

    return documents.withColumn("text", clean(F.coalesce(F.col("text"), F.lit(""))))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_novel")


def base_sha256(text: str) -> str:
    """Plain form of the base digest, for tests."""
    return hashlib.sha256(joined(Scanner().base(text)).encode()).hexdigest()
