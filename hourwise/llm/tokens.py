"""Token counts with a whole-token shortcut (operator 1)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What the tokenizer writes for a space.
SPACE = "▁"
#: Pre-tokens: a run of spaces with the word after it, or a line feed alone. The text begins with a space.
PRE_TOKEN = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+")
#: Learned counts that a worker keeps; at the limit it starts again from the proven table.
KEPT = 400_000
#: Longer pre-tokens are merged each time, never kept.
KEPT_LENGTH = 64


class PieceCounter:
    """Counts tokens of a byte-fallback BPE ``.model`` without merging what provably is one token.

    Proved from the vocabulary when it is loaded: (1) no piece holds a character followed by a space mark, nor a
    line feed with anything else, so no merge crosses a pre-token's edge and the counts of the pre-tokens add up;
    (2) ``whole`` has the pieces that the library itself encodes, standing alone, as just themselves. Pre-tokens
    found there count 1; the library merges only the others.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {i: m.id_to_piece(i) for i in range(m.get_piece_size())
                  if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}
        probe = m.encode(f" x  y\n z{SPACE}", out_type=str)
        self.splits = (not any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in pieces.values())
                       and "".join(probe).replace("<0x0A>", "\n") == f"{SPACE}{SPACE}x{SPACE}{SPACE}y\n{SPACE}z{SPACE}")
        self.lead = len(m.encode("\n"))
        ids = list(pieces)
        alone = m.encode([self._alone(pieces[i]) for i in ids])
        self.whole = {pieces[i]: 1 for i, got in zip(ids, alone, strict=True)
                      if got[0 if pieces[i][0] == SPACE else self.lead:] == [i]}
        self.known = dict(self.whole)

    @staticmethod
    def _alone(pre_token: str) -> str:
        """A text whose encoding is that of the pre-token: the library puts the first space itself; a pre-token
        without one stands after a line feed."""
        return pre_token[1:] if pre_token[0] == SPACE else "\n" + pre_token

    def _merge(self, new: list[str]) -> list[int]:
        got = self.model.encode([self._alone(x) for x in new], num_threads=1)
        return [len(g) - (0 if x[0] == SPACE else self.lead) if x != SPACE else 1 for x, g in zip(new, got, strict=True)]

    def counts(self, texts: list[str | None]) -> list[int]:
        if not self.splits:
            return [len(x) for x in self.model.encode([t or "" for t in texts], num_threads=1)]
        cut = [PRE_TOKEN.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        known = self.known
        if len(known) > KEPT:
            known = self.known = dict(self.whole)
        new = set().union(*cut).difference(known)
        long = {x for x in new if len(x) > KEPT_LENGTH}
        order = list(new)
        fresh = dict(zip(order, self._merge(order), strict=True)) if order else {}
        known.update((x, n) for x, n in fresh.items() if x not in long)
        if not long:
            return [sum(map(known.__getitem__, c)) + (t.count("\n") if t else 0) for c, t in zip(cut, texts, strict=True)]
        both = known | {x: fresh[x] for x in long}
        return [sum(map(both.__getitem__, c)) + (t.count("\n") if t else 0) for c, t in zip(cut, texts, strict=True)]


@lru_cache(maxsize=4)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 slice_chars: int = 1 << 20) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_bytes (UTF-8), n_tokens, as the library's ``encode`` gives them.

    NULL and empty texts have 0 of both; repeated rows are counted each; long texts are taken whole (texts of about
    ``slice_chars`` characters are counted together); an empty table gives an empty result; other columns are
    ignored. ``model_path`` must be a path that the workers can open, as installed packages are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(model_path)
        for b in batches:
            texts, out, lo = b.column(2).to_pylist(), [], 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars < slice_chars):
                    chars += len(texts[hi] or "")
                    hi += 1
                out += counter.counts(texts[lo:hi])
                lo = hi
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    src = docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col))
    kind = docs.schema[id_col].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
