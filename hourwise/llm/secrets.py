"""Secret scans by patterns and token efficiency (operator 6)."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the task: the three base patterns, with the least length of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of 24 or more: the maximal runs that count
ASSIGN_CHARS, ACCESS_CHARS = 6, 20
#: No ``ASSIGN`` match without one of these words.
ASSIGN_WORD = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
KINDS = ("assign", "access", "hex", "random")

#: Strings that the token test looks at: runs of characters of encoded data, and their parts between marks.
LEAST_CHARS = 8
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % LEAST_CHARS)
PART = re.compile(r"[A-Za-z0-9]+")
#: From this many characters a token on, a long string is taken for words; random strings stay near 1.5.
CHARS_PER_TOKEN = 2.4
#: Short words vary more, so less is asked of them: letters alone from SHORT characters a token at 8 characters up to the
#: whole limit at LONG_CHARS, those with a digit SHORT_DIGITS up to 15 characters and the whole limit from there on.
SHORT, SHORT_DIGITS, DIGITS_CHARS, LONG_CHARS = 1.5, 1.75, 16, 24
#: Letters alone in the case of a word (lower, upper, capitalised) are a word of some language below WORD_CHARS characters,
#: as the vocabulary knows one language best; from there on they are random below WORD characters a token, and WORD_MORE more for each further character.
WORD_CHARS, WORD, WORD_MORE = 16, 1.7, 0.04
#: No candidates whatever the ratio: digests by their length in hex, UUIDs, and numbers and dates (no letter).
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})\Z", re.I)
UUID = re.compile(r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-fA-F])")
NUMBER = re.compile(r"[0-9+/_=-]+\Z")
#: Words and short numbers joined by marks: the marks say nothing, what they join is scored.
JOINED = re.compile(r"[+/_=-]*(?:[A-Za-z]+|[0-9]{1,4})(?:[+/_=-]+(?:[A-Za-z]+|[0-9]{1,4}))*[+/_=-]*\Z")


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base matches in code points, end exclusive, in the order of a report."""
    out = []
    if ASSIGN_WORD.search(text):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2]))]


def limit(chars: int, digits: bool, chars_per_token: float, word: bool = False) -> float:
    """Characters a token below which a string of so many characters counts as random; ``word``: letters in a word's case."""
    if word:
        return 0.0 if chars < WORD_CHARS else min(chars_per_token, WORD + WORD_MORE * (chars - WORD_CHARS))
    if digits:
        return chars_per_token if chars >= DIGITS_CHARS else min(SHORT_DIGITS, chars_per_token)
    return min(chars_per_token, SHORT + (chars_per_token - SHORT) * (chars - LEAST_CHARS) / (LONG_CHARS - LEAST_CHARS))


def random_spans(text: str, base: list[tuple[int, int, str]], tokens, chars_per_token: float) -> list[tuple[int, int, str]]:
    """Strings outside all base spans that the vocabulary breaks into short tokens: runs as a whole, else those of their
    parts between marks. ``tokens`` counts the tokens of a string."""
    out = []
    free = lambda a, e: not any(x < e and a < y for x, y, _ in base)
    digit = lambda s: any(map(str.isdigit, s))
    word = lambda s: s.isalpha() and (s[1:].islower() or s.isupper())
    for m in CANDIDATE.finditer(text):
        s, at = m.group(), m.start()
        if DIGEST.match(s) or NUMBER.match(s):
            continue
        named = [x.span() for x in UUID.finditer(s)]
        parts = [x.span() for x in PART.finditer(s) if not any(a <= x.start() < e for a, e in named)]
        own = []
        for a, e in parts:
            x = s[a:e]
            if e - a < LEAST_CHARS or x.isdigit() or DIGEST.match(x) or not free(at + a, at + e):
                continue
            if e - a < limit(e - a, digit(x), chars_per_token, word(x)) * tokens(x):
                own.append((at + a, at + e, "random"))
        # a secret beside a readable name is reported without the name
        beside = own and any(e - a >= LEAST_CHARS and e - a >= chars_per_token * tokens(s[a:e]) for a, e in parts)
        if parts != [(0, len(s))] and free(at, m.end()) and not beside:
            if len(s) >= DIGITS_CHARS and digit(s) and not JOINED.match(s) and not named:
                chars, n = len(s), tokens(s)
            else:
                chars, n = sum(e - a for a, e in parts), sum(tokens(s[a:e]) for a, e in parts)
            words = all(word(s[a:e]) or s[a:e].isdigit() for a, e in parts)
            if chars >= LEAST_CHARS and chars < limit(chars, digit(s) and not JOINED.match(s), chars_per_token, words) * n:
                out.append((at, m.end(), "random"))
                continue
        out += own
    return out


def scan_secrets(docs: DataFrame, ranks_path: str, pattern: str, chars_per_token: float = CHARS_PER_TOKEN,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``spans`` (array of kind, start, end in code points, end exclusive).

    Kinds assign, access and hex are the base patterns, leftmost and non-overlapping by kind. Kind random has further
    runs of 8 or more characters of encoded data, or their parts between the marks = / + - _, with fewer characters a
    token under the vocabulary of ``ranks_path`` than the limit of their length and form (``limit``: ``chars_per_token``
    for long strings; letters in a word's case only from 16 characters on). Digests by length, UUIDs and what has no letter (numbers, dates) are left out; words and numbers of
    up to four digits joined by marks are scored without the marks. Spans are ordered by start, then kind. A NULL or
    empty text has none; repeated rows are scanned each; long texts are scanned whole; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks_path, pattern).encode_ordinary
        # a word in a text mostly follows a space, which belongs to its first token
        tokens = lru_cache(maxsize=1 << 17)(lambda s: min(len(encode(s)), len(encode(" " + s))))
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base = base_spans(text) if text else []
                more = random_spans(text, base, tokens, chars_per_token) if text else []
                rows.append([{"kind": k, "start": a, "end": e} for a, e, k in sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, SPANS)], names=[id_col, "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind: string, start: long, end: long>>")


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
