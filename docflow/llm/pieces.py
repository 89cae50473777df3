"""Cutting of oversized texts at natural boundaries by pointer doubling (problem 3).

Every token boundary of a text that lies between letters gets its farthest legal successor: the end of a piece that starts
there, at the best kind of boundary within the limit (sentence or line, then clause, then word, then any), and from it the next
start, so that the pieces share the wanted number of tokens. The successor tables of all texts of a batch are squared together,
and the marks of the starts double with them, so all greedy cuts come out in a logarithmic number of steps.

A piece's tokens are those of the whole text in its span: a token boundary between characters cuts a valid encoding into valid ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.bpe import CHUNK, FOLDER, VOCABULARY, Vocabulary, vocabulary
from docflow.llm.sentences import spans
from docflow.llm.tables import small, spread

CLAUSE = re.compile(r"[,;:，；：、—–)）]")
MARK = regex.compile(r"[\p{M}\u200d]")
SENTENCE, CLAUSE_END, WORD, ANY = 3, 2, 1, 0


@dataclass
class Bounds:
    """Boundaries of one text: code point, tokens before, kind."""

    at: np.ndarray
    tokens: np.ndarray
    kind: np.ndarray


def bounds(text: str, v: Vocabulary) -> Bounds:
    raw = text.encode("utf-8", "surrogatepass")
    words = v.words.findall(text)
    per = [v.memo[w] if w in v.memo else tuple(v.merged(w.encode("utf-8", "surrogatepass"))) for w in words]
    sizes = np.array([len(v.bytes[t]) for ts in per for t in ts], dtype=np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    b = np.frombuffer(raw, dtype=np.uint8)
    first = np.concatenate(((b & 0xC0) != 0x80, [True]))  # whether a character begins here
    chars = np.concatenate(([0], np.cumsum(first[:-1])))
    ok = first[ends]
    joining = [m.start() for m in MARK.finditer(text)]  # nor is a letter parted from its marks
    if joining:
        ok &= ~np.isin(chars[ends], joining) | (ends == 0)
    at = chars[ends][ok]
    tokens = np.flatnonzero(ok)
    kind = np.zeros(len(at), np.int8)
    word_ends = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    kind[np.isin(at, word_ends)] = WORD
    kind[np.isin(at, [m.end() for m in CLAUSE.finditer(text)]) & (kind == WORD)] = CLAUSE_END
    kind[np.isin(at, [e for _, e in spans(text)])] = SENTENCE
    kind[[0, -1]] = SENTENCE
    return Bounds(at, tokens, kind)


def cuts(items: list[Bounds], limits: list[int], overlaps: list[int]) -> list[list[tuple[int, int]]]:
    """(first boundary, last boundary) of each text's pieces, in order."""
    sizes = np.array([len(x.at) for x in items])
    base = np.concatenate(([0], np.cumsum(sizes)))
    limit = np.repeat(np.maximum(1, np.array(limits, np.int64)), sizes)
    lap = np.repeat(np.minimum(np.maximum(0, np.array(overlaps, np.int64)), np.maximum(1, np.array(limits, np.int64)) - 1), sizes)
    owner = np.repeat(np.arange(len(items)), sizes)
    room = max(int(x.tokens[-1]) for x in items) + int(limit.max()) + 2
    tokens = np.concatenate([x.tokens for x in items]) + owner * room
    kind = np.concatenate([x.kind for x in items])
    last = base[owner + 1] - 1
    n = len(tokens)
    here = np.arange(n)
    far = np.minimum(np.searchsorted(tokens, tokens + limit, side="right") - 1, last)
    end = np.minimum(np.maximum(far, here + 1), last)  # a character of more tokens than the limit stays whole
    done = np.zeros(n, dtype=bool)
    for k in (SENTENCE, CLAUSE_END, WORD):
        best = np.maximum.accumulate(np.where(kind >= k, here, -1))[end]
        fits = ~done & (best > here) & ((tokens[best] - tokens > lap) | (best == last))
        end = np.where(fits, best, end)
        done |= fits
    after = np.searchsorted(tokens, tokens[end] - lap, side="right") - 1
    after = np.where(end == last, here, np.maximum(after, here + 1))  # a text's last piece is its own successor
    reached = np.zeros(n, dtype=bool)
    reached[base[:-1]] = True
    jump = after
    while True:
        more = reached.copy()
        more[jump[reached]] = True
        squared = jump[jump]
        if (more == reached).all() and (squared == jump).all():
            break
        reached, jump = more, squared
    out: list[list[tuple[int, int]]] = [[] for _ in items]
    for s in np.flatnonzero(reached):
        i = owner[s]
        out[i].append((int(s - base[i]), int(end[s] - base[i])))
    return out


PIECE = "segment_id bigint, n_text_tokens bigint, piece_ord int, start_pos int, end_pos int, n_tokens int, text string"


def split(segments: DataFrame, options: DataFrame, folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """The pieces of every segment whose text has more tokens than max_input_tokens of its options.

    piece_ord counts from 0; start_pos and end_pos are code points. Null and empty texts, and segments without options or without a
    limit, give no pieces; a limit below 1 counts as 1, an overlap of the limit or more as one token less. Repeated rows each give
    their pieces; of options that differ under one id those of the greatest limit count, then of the greatest overlap.
    """
    best = F.max(F.struct("max_input_tokens", "overlap_tokens")).alias("best")
    opts = small(options.where("options_id is not null").groupBy(F.col("options_id").alias("o")).agg(best).select("o", "best.*"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(folder, name)
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                ids, texts, limits, laps = (c.to_pylist() for c in part.columns)
                n = v.counts(texts)
                big = [i for i in range(len(ids)) if n[i] > limits[i]]
                if not big:
                    continue
                found = [bounds(texts[i], v) for i in big]
                rows = []
                for i, x, ps in zip(big, found, cuts(found, [limits[i] for i in big], [laps[i] or 0 for i in big])):
                    for k, (s, e) in enumerate(ps):
                        rows.append((ids[i], n[i], k, int(x.at[s]), int(x.at[e]), int(x.tokens[e] - x.tokens[s]), texts[i][x.at[s] : x.at[e]]))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[2:6]), pa.array(cols[6], pa.string())], names=["segment_id", "n_text_tokens", "piece_ord", "start_pos", "end_pos", "n_tokens", "text"])

    # a text of fewer bytes than the limit can't have more tokens: it needn't reach Python
    rows = spread(segments.select("segment_id", "text", "options_id").where("text is not null and options_id is not null"))
    fed = rows.join(opts, F.col("options_id") == F.col("o")).where(F.octet_length("text") > F.col("max_input_tokens"))
    return fed.select("segment_id", "text", F.col("max_input_tokens").cast("int"), F.col("overlap_tokens").cast("int")).mapInArrow(run, PIECE)
