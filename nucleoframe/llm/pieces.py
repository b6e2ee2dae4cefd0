"""Cutting oversized texts at natural boundaries, with overlap.

A text becomes a string of one letter per token that says what kind of boundary follows the token.
One regular expression with bounded quantifiers walks that string: its alternatives, strongest
boundary first, consume as many tokens as the limit allows, and fall back to any character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nucleoframe.llm.tokens import VOCABULARY, encode, encoding
from nucleoframe.session import with_once

#: Boundary kinds, strongest first: paragraph, interruption, sentence, word; c between
#: characters of a word, b inside a character, where no cut may fall.
KINDS = "PISWcb"
#: Behind these a full stop ends no sentence (fixed values).
ABBREVIATIONS = "Mr Mrs Ms Dr Prof St Nr No Abs Art Vol vol p pp M Mme Sr Sra Hr Fr Frau Doc ca bzw Av Exmo Exma art nr no"
_ABBREVIATED = frozenset(ABBREVIATIONS.split())
_LONGEST = max(map(len, _ABBREVIATED))
#: Characters that may stand between a full stop and the end of a sentence (fixed values).
_CLOSERS, _CJK_CLOSERS = "\"'»”’)]", "」』”）"
_ENDS, _CJK_ENDS = ".!?…", "。！？"
_BREAKS, _CJK_BREAKS = ")]", "）"
#: Bytes of a text that lie together; a piece is taken from the chunks it lies in.
CHUNK = 16_384


def _token_lengths(vocabulary: str, cache: dict = {}) -> np.ndarray:  # noqa: B006
    if vocabulary not in cache:
        enc = encoding(vocabulary)
        cache[vocabulary] = np.array([len(enc.decode_single_token_bytes(i)) if i < enc.n_vocab else 0 for i in range(enc.n_vocab)], np.int64)
    return cache[vocabulary]


def _classes(cache: dict = {}) -> dict[str, np.ndarray]:  # noqa: B006
    """Which code points are white space, part of a word, or closing; once per Python worker."""
    if not cache:
        every = [chr(c) for c in range(0x110000)]
        cache["space"] = np.array([c.isspace() for c in every])
        cache["word"] = np.array([c.isalnum() or c == "_" for c in every])
        for name, chars in (("closer", _CLOSERS), ("cjk_closer", _CJK_CLOSERS), ("end", _ENDS), ("cjk_end", _CJK_ENDS), ("break", _BREAKS), ("cjk_break", _CJK_BREAKS)):
            cache[name] = np.zeros(0x110000, bool)
            cache[name][[ord(c) for c in chars]] = True
    return cache


def _next_without(mask: np.ndarray) -> np.ndarray:
    """For each place up to the end the first place from it on where the mask doesn't hold."""
    at = np.append(np.where(mask, len(mask), np.arange(len(mask))), len(mask))
    return np.minimum.accumulate(at[::-1])[::-1]


def _abbreviated(text: str, stop: int, begin: int) -> bool:
    """Whether the word before a full stop is one behind which no sentence ends."""
    word = text[begin:stop]
    return len(word) == 1 or word in _ABBREVIATED or word.isdigit()


def boundary_kinds(text: str) -> np.ndarray:
    """For each place in a text, 0 to its length, the rank of the boundary there in KINDS."""
    classes = _classes()
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code)
    kind = np.full(n + 1, KINDS.index("c"), np.int8)
    if n:
        space = classes["space"][code]
        blank_at = np.append(space, False)
        # A word ends before a blank between two visible characters, and begins behind a line's end.
        here = np.nonzero((code[1:-1] == 32) & ~space[:-2] & ~space[2:])[0] + 1
        line = np.nonzero((code[:-1] == 10) & ~space[1:])[0] + 1
        kind[here] = kind[line] = KINDS.index("W")
        # A sentence ends behind its last sign and what closes it, if a blank follows.
        stop = np.nonzero(classes["end"][code])[0]
        end = _next_without(classes["closer"][code])[stop + 1]
        kept = blank_at[end]
        stop, end = stop[kept], end[kept]
        letters = classes["word"][code]
        begin = np.maximum.accumulate(np.where(letters, 0, np.arange(1, n + 1)))
        begin = np.concatenate([[0], begin])[stop]
        # Only short words and words that end in a digit can be abbreviations or numbers.
        digit = (stop > 0) & (code[np.maximum(stop - 1, 0)] - 48 < 10)
        doubt = np.nonzero((code[stop] == 46) & (begin < stop) & ((stop - begin <= _LONGEST) | digit))[0]
        sure = np.ones(len(stop), bool)
        sure[doubt] = [not _abbreviated(text, s, b) for s, b in zip(stop[doubt].tolist(), begin[doubt].tolist())]
        kind[end[sure]] = KINDS.index("S")
        wide = np.nonzero(classes["cjk_end"][code])[0]
        kind[_next_without(classes["cjk_closer"][code])[wide + 1]] = KINDS.index("S")
        shut = np.nonzero(classes["break"][code])[0] + 1
        kind[shut[blank_at[shut]]] = KINDS.index("I")
        kind[np.nonzero(classes["cjk_break"][code])[0] + 1] = KINDS.index("I")
        kind[_next_without(space)[np.nonzero(code == 10)[0]]] = KINDS.index("P")
    kind[n] = KINDS.index("P")
    return kind


def _marked(limit: int, vocabulary: str, keep: list[str]):
    letters = np.frombuffer(KINDS.encode(), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _token_lengths(vocabulary)
        for batch in batches:
            rows, marks, ends, raws = [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                ids = encode(text, vocabulary)
                if len(ids) <= limit:
                    continue
                raw = text.encode("utf-8")
                lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
                at = np.cumsum(lengths[ids])
                place = np.concatenate([[0], np.cumsum(lead)])[at]
                whole = np.append(lead, True)[at]
                kind = np.where(whole, boundary_kinds(text)[place], KINDS.index("b"))
                rows.append(k)
                marks.append(letters[kind].tobytes().decode())
                ends.append(at.astype(np.int32))
                raws.append([raw[a : a + CHUNK] for a in range(0, len(raw), CHUNK)])
            if rows:
                split = np.concatenate([[0], np.cumsum([len(e) for e in ends])]).astype(np.int32)
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(raws, pa.list_(pa.binary())), pa.array(marks), pa.ListArray.from_arrays(pa.array(split), pa.array(np.concatenate(ends)))], names=[*keep, "chunks", "marks", "ends"])

    return run


def cut_texts(docs: DataFrame, id_col: str, text_col: str, limit: int, overlap: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of the texts of more than ``limit`` tokens: id, piece_no, token_start, token_end, new_start, cut, text.

    A piece has at most ``limit`` tokens of the text's encoding: up to ``limit - overlap`` new
    ones from new_start to token_end, and before them whole words that make at most ``overlap``
    tokens of the piece before. ``cut`` names the boundary at its end: P paragraph, I
    interruption, S sentence, W word, c inside a word. A boundary counts from half a piece on;
    the strongest wins, and of those the last. Without overlap the pieces are the text again.
    Shorter, empty and null texts have no row. An empty table gives an empty result.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    most, half = limit - overlap, max(1, (limit - overlap) // 2)
    long = docs.where(F.octet_length(text_col) > limit).select(id_col, F.col(text_col).alias("text"))
    schema = T.StructType([docs.schema[id_col], T.StructField("chunks", T.ArrayType(T.BinaryType())), T.StructField("marks", T.StringType()), T.StructField("ends", T.ArrayType(T.IntegerType()))])
    marked = long.mapInArrow(_marked(limit, vocabulary, [id_col]), schema)
    steps = [f"[A-Za-z]{{1,{most}}}$"] + [f"[A-Za-z]{{{half - 1},{most - 1}}}{k}" for k in "PISW"] + [f"[A-Za-z]{{0,{most - 1}}}[PISWc]", f"[A-Za-z]{{1,{most}}}"]
    runs = with_once(marked, runs=F.regexp_extract_all("marks", F.lit("|".join(steps)), F.lit(0)))
    grown = F.aggregate("runs", F.array(F.lit(0)), lambda acc, r: F.array_append(acc, F.element_at(acc, -1) + F.length(r)))
    cuts = with_once(runs, cuts=grown)

    def placed(k: Column) -> Column:
        start, run = F.element_at("cuts", k), F.element_at("runs", k)
        # Look back: the first whole-word boundary at most ``overlap`` tokens before the new part. The
        # marks there end the run before; only after a run shorter than the overlap all marks are asked.
        far = F.greatest(start - overlap, F.lit(0))
        before = F.get("runs", k - 2)
        window = F.when(F.length(before) > overlap, F.right(before, F.lit(overlap + 1))).otherwise(F.substring("marks", F.greatest(far, F.lit(1)), start - far + F.when(far > 0, 1).otherwise(0)))
        word, char = F.regexp_instr(window, F.lit("[PISW]")), F.regexp_instr(window, F.lit("[PISWc]"))
        begin = F.when((start == 0) | (F.lit(overlap) == 0), start).when(far == 0, F.lit(0)).otherwise(F.least(far + F.when(word > 0, word).otherwise(char) - 1, start))
        return F.struct((k - 1).alias("piece_no"), begin.alias("token_start"), F.element_at("cuts", k + 1).alias("token_end"), start.alias("new_start"), F.right(run, F.lit(1)).alias("cut"))

    each = with_once(cuts, pieces=F.transform(F.sequence(F.lit(1), F.size("runs")), placed))

    def sliced(p: Column) -> Column:
        byte_at = lambda t: F.when(t > 0, F.element_at("ends", F.greatest(t, F.lit(1)))).otherwise(0)
        lo, hi = byte_at(p["token_start"]), byte_at(p["token_end"])
        part = lambda c: F.substring(F.element_at("chunks", c + 1), F.greatest(lo - c * CHUNK, F.lit(0)) + 1, F.least(hi, (c + 1) * CHUNK) - F.greatest(lo, c * CHUNK)).cast("string")
        text = F.array_join(F.transform(F.sequence(F.floor(lo / CHUNK).cast("int"), F.floor((hi - 1) / CHUNK).cast("int")), part), "")
        return F.struct(*[p[c].alias(c) for c in ("piece_no", "token_start", "token_end", "new_start", "cut")], text.alias("text"))

    # Bytes are sliced where they lie; only the pieces are exploded, so work grows with the text.
    return each.select(id_col, F.inline(F.transform("pieces", sliced)))
