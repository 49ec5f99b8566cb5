"""Token counts by trie-shared dynamic programming over a unigram vocabulary.

A pre-token is a word with the space mark before it. Its best segmentation has the highest sum of
piece scores; the forward scores of a prefix depend on the prefix alone. The distinct pre-tokens
of a task are sorted, so that walking them is a walk through their trie, and each trie node's
forward score is computed once for all pre-tokens that share it. A pre-token's end (its terminal
node) stores its number of tokens; a text's count is the sum over its words.

A character that is no piece costs one token per UTF-8 byte. Equal scores go to fewer tokens. Null
and "" have no words; repeated rows are counted each for itself; extra columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from assay.llm.common import frugal, slices

SPACE = "▁"
#: Distinct pre-tokens whose counts one task keeps; the memory starts anew when full.
CACHE_WORDS = 400_000


def piece_scores(path: str) -> dict[str, float]:
    """Unigram log-probabilities for the pieces of a model file. The file has no probabilities, but
    its order is one of frequency; a piece of rank r gets the Zipf estimate 1 / (r H)."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / r for r in range(1, len(names) + 1)))
    return {name: -math.log(r) - total for r, name in enumerate(names, 1)}


class TrieCounter:
    """Forward scores along the trie of the pre-tokens seen."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0.0) - 10.0  # of a byte token
        # Which lengths the pieces with given last two characters have, longest first.
        ends: dict[str, set[int]] = {}
        for piece in scores:
            ends.setdefault(piece[-2:], set()).add(len(piece))
        self.ends = {tail: tuple(sorted(n, reverse=True)) for tail, n in ends.items()}

    def count(self, words: Iterable[str]) -> dict[str, int]:
        """Tokens of each distinct word."""
        scores, ends = self.scores, self.ends
        out: dict[str, int] = {}
        path, best, tokens = "", [0.0], [0]  # the nodes from the root to the last word's end
        for word in sorted(words):
            text = SPACE + word
            shared = 0
            for a, b in zip(path, text, strict=False):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for at in range(shared + 1, len(text) + 1):
                last = text[at - 1]
                own = scores.get(last)
                if own is None:
                    n = len(last.encode("utf-8", "surrogatepass"))
                    top, used = best[at - 1] + n * self.byte, tokens[at - 1] + n
                else:
                    top, used = best[at - 1] + own, tokens[at - 1] + 1
                if at > 1:
                    for n in ends.get(text[at - 2 : at], ()):
                        if n <= at:
                            s = scores.get(text[at - n : at])
                            if s is not None:
                                s += best[at - n]
                                k = tokens[at - n] + 1
                                if s > top or s == top and k < used:
                                    top, used = s, k
                best.append(top)
                tokens.append(used)
            path = text
            out[word] = tokens[-1]
        return out


SCHEMA = "doc_id long, n_words long, n_tokens long"


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, words and tokens. One narrow pass."""

    def run(batches):
        counter = TrieCounter(piece_scores(path))
        known: dict[str, int] = {}
        for part in slices(batches, 1, 8 << 20):
            words = [(t or "").split() for t in part.column(1).to_pylist()]
            new = set().union(*words).difference(known)
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = set().union(*words)
            known |= counter.count(new)
            tokens = [sum(n * known[w] for w, n in Counter(ws).items()) for ws in words]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, words), pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(frugal(run), SCHEMA)
