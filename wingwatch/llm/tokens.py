"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary piece that ends at each character; the
dynamic programme carries only the best score and the piece count at each place, no paths.
Ties follow the unigram tokenizers: a piece that starts earlier wins over an equal later one, and
an unknown character (minimum score less ``UNKNOWN_PENALTY``) counts last.  With byte fallback an
unknown character counts one token a UTF-8 byte; without it a run of unknown ones is one token.

The vocabulary is read from a file of a public tokenizer (``path``); pieces and scores are taken as
they stand there.  In no known vocabulary a piece continues past the space marker, so texts are cut
before each marker that follows another character; scores add up over such cuts, and the counts of
the frequent cuts are remembered by each task.  Where a piece does cross, whole texts are worked
off instead.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
REMEMBER, REMEMBER_CHARS = 300_000, 48


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[tuple[str, float], ...]
    byte_fallback: bool
    prefix: bool  # a space marker is put before the text

    @property
    def unknown_score(self) -> float:
        return min((s for _, s in self.pieces), default=0.0) - UNKNOWN_PENALTY


def load_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """Normal pieces of a SentencePiece model without a character map, or of a tokenizers file
    whose model is of type Unigram."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model.get("type") != "Unigram":
            raise ValueError("not a unigram vocabulary")
        pieces = [(p, float(s)) for i, (p, s) in enumerate(model["vocab"]) if i != model.get("unk_id")]
        fallback = bool(model.get("byte_fallback"))
        if fallback:
            pieces = [x for x in pieces if not re.fullmatch("<0x[0-9A-F]{2}>", x[0])]
        return Vocabulary(tuple(pieces), fallback, True)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if sp.normalize("ﬁ　 x") != SPACE + "ﬁ　" + SPACE + "x":
        raise ValueError("the vocabulary maps characters; only identity maps are supported")
    pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())
              if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return Vocabulary(tuple(pieces), any(sp.is_byte(i) for i in range(sp.get_piece_size())), True)


class Counter:
    """Counts tokens of texts under one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.unknown = vocabulary.unknown_score
        self.single = {p for p, _ in vocabulary.pieces if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, s in vocabulary.pieces:
            if p:
                self.automaton.add_word(p, (len(p), s))
        self.ready = len(self.automaton) > 0
        if self.ready:
            self.automaton.make_automaton()
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in vocabulary.pieces)
        # a character that no piece holds is a token (or bytes) of its own whatever stands around it
        line = "\n" if vocabulary.byte_fallback and not any("\n" in p for p, _ in vocabulary.pieces) else ""
        self.cuts = None if crossing or SPACE not in self.single else re.compile(
            f"{line}|{SPACE}*[^{SPACE}{line}]+|{SPACE}+" if line else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.known: dict[str, tuple[float, int]] = {}

    def viterbi(self, text: str) -> tuple[float, int]:
        """(best score, pieces of the best segmentation)."""
        n = len(text)
        score, count, run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ends = self.automaton.iter(text) if self.ready else iter(())
        hit = next(ends, None)
        for e in range(n):
            best, length = None, 0
            while hit is not None and hit[0] == e:
                size, s = hit[1]
                s += score[e + 1 - size]
                if best is None or s > best or (s == best and size > length):
                    best, length = s, size
                hit = next(ends, None)
            unknown = False
            if text[e] not in self.single:
                s = score[e] + self.unknown
                if best is None or s > best:
                    best, length, unknown = s, 1, True
            score[e + 1], run[e + 1] = best, unknown
            if not unknown:
                count[e + 1] = count[e + 1 - length] + 1
            elif self.v.byte_fallback:
                count[e + 1] = count[e] + len(text[e].encode("utf-8", "surrogatepass"))
            else:
                count[e + 1] = count[e] + (not run[e])
        return score[n], count[n]

    def __call__(self, text: str | None) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        text = (SPACE if self.v.prefix else "") + text.replace(" ", SPACE)
        if self.cuts is None:
            return self.viterbi(text)
        score, n, known = 0.0, 0, self.known
        for cut in self.cuts(text):
            found = known.get(cut)
            if found is None:
                found = self.viterbi(cut)
                if len(cut) <= REMEMBER_CHARS:
                    if len(known) >= REMEMBER:
                        known.clear()
                    known[cut] = found
            score += found[0]
            n += found[1]
        return score, n


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, carry: list[str]) -> DataFrame:
    """``carry`` columns plus n_tokens and best_score for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the size of the vocabulary file
    rows = docs.select(*carry, docs["text"].alias("text_"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
                       + ["n_tokens long", "best_score double"])

    def run(batches):
        count = Counter(shared.value)
        for b in batches:
            found = [count(t.as_py()) for t in b.column("text_")]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([n for _, n in found], pa.int64()), pa.array([s for s, _ in found], pa.float64())],
                [*carry, "n_tokens", "best_score"])

    return rows.mapInArrow(run, schema)


def op4_count_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, best_score for every row of ``docs``; a null or empty text has no tokens.
    Very long texts without spaces need memory in proportion to their length, nothing else."""
    return count_tokens(docs, load_vocabulary(path), ["doc_id"])
