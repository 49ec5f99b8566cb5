"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

A sequence of tokens is the BPE encoding of its text exactly when every two neighbours would
not have merged across their border. So the encoding of each prefix ends in the one token that
fits the encoding before it, and a left-to-right pass needs only the last ``lookahead`` symbols
(the longest token of the merge list): each later token starts at one of those positions. A
token is stable, and is emitted, as soon as the back chains of all those positions share it.

Texts: null and "" give no tokens; special tokens in a text become their ids; repeated rows are
encoded each for itself; extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import contextlib
import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from assay.llm.common import chunked, frugal, slices

#: Words kept per worker with their encoding, twice, and token pairs kept with whether they fit.
CACHE_WORDS = 80_000
CACHE_PAIRS = 250_000
#: Beginnings of words kept with the token that ends their encoding.
CACHE_STARTS = 150_000
#: Symbols of a text up to which its pieces are found in one call.
FIND_ALL = 100_000
#: Pieces of one text that are hashed together.
DIGEST_PIECES = 50_000


# Letters and numbers of later Unicode versions that the vocabulary's library does not take for such (first
# and last of each range), and capitals that it knows and Python's tables may not: single ones, and ranges with their distance.
NO_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F),
    (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
NO_NUMBERS = ((0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6))
CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
CAPITAL_RANGES = ((0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B))


def capitals() -> dict[int, int]:
    return CAPITALS | {c: c + step for first, last, step in CAPITAL_RANGES for c in range(first, last + 1)}


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level BPE files."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Transducer:
    """Encoder state built from a tokenizer file's merge list."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.decoder = (spec.get("decoder") or {}).get("type")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.born: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        born, halves = self.born, self.halves
        self.rank: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            pair = self.vocab[a], self.vocab[b]
            made = self.vocab[a.removesuffix(self.suffix) + b if self.suffix else a + b]
            self.rank[pair] = r
            if made not in born:
                born[made], halves[made] = r, pair
        reachable = {t for t in self.vocab.values() if t not in halves or self._holds(*halves[t], born[t])}
        for t in sorted(halves, key=born.get):
            if t in reachable and not reachable.issuperset(halves[t]):
                reachable.discard(t)
        self.inner, self.final = {}, {}
        for text, t in self.vocab.items():
            if t in reachable:
                if self.suffix and text.endswith(self.suffix) and text != self.suffix:
                    self.final[text.removesuffix(self.suffix)] = t
                else:
                    self.inner[text] = t
        if not self.suffix:
            self.final = self.inner
        self.lookahead = max(map(len, [*self.inner, *self.final]))
        self.lengths = {id(d): self._lengths(d) for d in (self.inner, self.final)}
        self.fits: dict[int, bool] = {}
        self.starts: dict[str, int] = {}
        letters = byte_alphabet()
        self.letters = {b: letters[b] for b in range(256)}
        self.bytes = {c: b for b, c in self.letters.items()}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        # The word pattern of this vocabulary's format, with the white space that it means.
        space = r"\t-\r \x85\xa0  -     　"
        span = lambda ranges: "".join(f"{chr(x)}-{chr(y)}" for x, y in ranges)
        letter, number = rf"[\p{{L}}--[{span(NO_LETTERS)}]]", rf"[\p{{N}}--[{span(NO_NUMBERS)}]]"
        ends = "'s|'t|'re|'ve|'m|'ll|'d"
        self.words = regex.compile(rf"{ends}|[\p{{L}}]+|[\p{{N}}]|[^{space}\p{{L}}\p{{N}}]+")
        # the same for texts that have one of the characters on which the tables differ
        self.odd_words = regex.compile(rf"(?V1){ends}|{letter}+|{number}|[^{space}{letter}{number}]+")
        self.capitals = capitals()
        self.odd = frozenset(chr(c) for x, y in NO_LETTERS + NO_NUMBERS for c in range(x, y + 1)) | frozenset(map(chr, self.capitals))

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Symbols at a token's left (0) or right (1) edge while it was built, each with the merge that ended it."""
        end = len(self.rank)
        out = [(token, end)]
        while token in self.halves:
            end = min(end, self.born[token])
            token = self.halves[token][side]
            out.append((token, end))
        return out

    def _holds(self, a: int, b: int, before: int) -> bool:
        """Whether no merge across the border of a and b comes before rank ``before``."""
        rank, left = self.rank, self._edge(b, 0)
        for x, ends in self._edge(a, 1):
            for y, stops in left:
                r = rank.get((x, y))
                if r is not None and r < before and r < ends and r <= stops:
                    return False
        return True

    @staticmethod
    def _lengths(tokens: dict[str, int]) -> dict[str, tuple[int, ...]]:
        """Lengths, longest first, of the tokens that can end where the last three symbols (fewer at a start) stand."""
        by: dict[str, set[int]] = {}
        for t in tokens:
            by.setdefault(t[-3:], set()).add(len(t))
        for tail in list(by):
            if len(tail) == 3:
                by[tail] |= {n for n in (1, 2) if tail[-n:] in tokens}
        for tail in [t for t in by if len(t) == 2]:
            by[tail] |= {1} if tail[-1:] in tokens else set()
        return {tail: tuple(sorted(n, reverse=True)) for tail, n in by.items()}

    def _fit(self, a: int, b: int) -> bool:
        if len(self.fits) > CACHE_PAIRS:
            self.fits.clear()
        ok = self.fits[a << 32 | b] = self._holds(a, b, len(self.rank))
        return ok

    def _ending(self, held: str, at: int, last: list[int], before: int, tokens: dict[str, int]) -> tuple[int, int]:
        """The one token that fits the encoding of what stands before it in held[:at], and its length."""
        tail = held[max(0, at - 3) : at]
        lengths = self.lengths[id(tokens)]
        fits = self.fits
        for n in lengths.get(tail) or (*(lengths.get(tail[-2:]) or ()), 1):
            if n <= at:
                t = tokens.get(held[at - n : at])
                if t is not None:
                    p = last[at - n] if at > n else before
                    if p < 0:
                        return t, n
                    ok = fits.get(p << 32 | t)
                    if ok or ok is None and self._fit(p, t):
                        return t, n
        raise ValueError(f"no token fits {held[:at]!r}")

    def stream(self, symbols: Iterable[str]) -> Iterator[int]:
        """Token ids of one word given symbol by symbol; at most a few lookaheads of symbols are held."""
        far, inner, ending = self.lookahead, self.inner, self._ending
        held, last, size = "", [-1], [0]  # last[i], size[i]: the token that ends the encoding of held[:i]
        before = -1  # the token emitted just before held
        symbols = iter(symbols)
        ahead = next(symbols, None)
        limit = 3 * far
        while ahead is not None:
            held += ahead
            ahead = next(symbols, None)
            t, n = ending(held, len(held), last, before, inner if ahead is not None else self.final)
            last.append(t)
            size.append(n)
            if ahead is not None and len(held) >= limit:
                cut = self._stable(size)
                if cut:
                    out = self._chain(last, size, cut)
                    yield from out
                    before = out[-1]
                    held, last, size = held[cut:], [-1, *last[cut + 1 :]], [0, *size[cut + 1 :]]
                limit = len(held) + 2 * far
        if held:
            yield from self._chain(last, size, len(held))

    def _stable(self, size: list[int]) -> int:
        """The last border that the chains of all positions from which a later token can start have in common."""
        live = set(range(max(0, len(size) - self.lookahead), len(size)))
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(top - size[top])
            if 0 in live:
                return 0
        return live.pop()

    @staticmethod
    def _chain(last: list[int], size: list[int], at: int) -> list[int]:
        out = []
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def word(self, word: str) -> list[int]:
        """Token ids of one pre-token."""
        symbols = word if word.isascii() and word.isalnum() else "".join(map(self.letters.__getitem__, word.encode()))
        whole = self.final.get(symbols)
        if whole is not None:
            return [whole]
        if len(symbols) > 3 * self.lookahead:
            return list(self.stream(symbols))
        # A word that fits the window needs no emission before its end: only the beginnings that its tokens are tried
        # after are looked at, and words share them.
        if len(self.starts) > CACHE_STARTS:
            self.starts.clear()
        t, n = self._closing(symbols, self.final)
        out, end = [t], len(symbols) - n
        while end:
            t = self._last(symbols[:end])
            out.append(t)
            end -= len(self.tokens[t])
        return out[::-1]

    def _last(self, start: str) -> int:
        """The token that ends the encoding of the beginning of a word."""
        t = self.starts.get(start)
        if t is None:
            t = self.starts[start] = self._closing(start, self.inner)[0]
        return t

    def _closing(self, held: str, tokens: dict[str, int]) -> tuple[int, int]:
        """What _ending finds, from the beginnings themselves."""
        at, fits, starts = len(held), self.fits, self.starts
        lengths = self.lengths[id(tokens)]
        for n in lengths.get(held[-3:]) or (*(lengths.get(held[-2:]) or ()), 1):
            if n <= at:
                t = tokens.get(held[at - n :])
                if t is not None:
                    if n == at:
                        return t, n
                    start = held[: at - n]
                    p = starts.get(start)
                    if p is None:
                        p = self._last(start)
                    ok = fits.get(p << 32 | t)
                    if ok or ok is None and self._fit(p, t):
                        return t, n
        raise ValueError(f"no token fits {held!r}")

    def pieces(self, text: str) -> Iterator[str | int]:
        """Normalised pre-tokens of a text in order; a special token comes as its id."""
        start, marks = 0, self.cut.finditer(text) if self.cut and "<" in text else ()
        for m in [*marks, None]:
            part = text[start : m.start() if m else len(text)]
            if part:
                words = self.words
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                    if not self.odd.isdisjoint(part):
                        part, words = part.translate(self.capitals), self.odd_words
                part = part.lower()
                yield from words.findall(part) if len(part) <= FIND_ALL else map(regex.Match.group, words.finditer(part))
            if m:
                yield self.special[m.group()]
                start = m.end()


class Decoder:
    """Text from ids, piece by piece. A file without a decoder joins its token strings with spaces;
    a byte-level one turns bytes into text as soon as a character is whole."""

    def __init__(self, transducer: Transducer, plain: bool | None = None):
        self.of = transducer
        self.plain = transducer.decoder is None if plain is None else plain
        self.first = True
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        names = [self.of.tokens[i] for i in ids]
        if self.plain:
            out = " ".join(names)
            if names and not self.first:
                out = " " + out
            self.first = self.first and not names
            return out
        out, suffix = [], self.of.suffix
        for i, name in zip(ids, names, strict=True):
            if i in self.of.special.values():
                out.append(name)
                continue
            end = bool(suffix) and name.endswith(suffix)
            out.append(self.utf8.decode(bytes(self.of.bytes[c] for c in (name.removesuffix(suffix) if end else name))))
            if end:
                out.append(" ")
        return "".join(out)

    def close(self) -> str:
        return "" if self.plain else self.utf8.decode(b"", True)


class Words(dict):
    """What is known of the pieces met lately. When full, the words of the time before the last filling are forgotten."""

    def __init__(self, make):
        super().__init__()
        self.make, self.former = make, {}

    def __missing__(self, piece: str | int):
        value = self.former.get(piece) or self.make(piece)
        if len(self) >= CACHE_WORDS:
            self.former = dict(self)
            self.clear()
        if isinstance(piece, int) or len(piece) <= 64:
            self[piece] = value
        return value


class Encoder:
    """Whole texts; distinct words are encoded once while they are kept."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer
        self.ids, self.spelled = Words(self._ids), Words(self._spell)
        self.whole = {i: (1, str(i), name) for i, name in self.transducer.tokens.items()}

    def _ids(self, piece: str | int) -> tuple[int, ...]:
        return (piece,) if isinstance(piece, int) else tuple(self.transducer.word(piece))

    def _spell(self, piece: str | int) -> tuple[int, str, str]:
        """Number of ids, the ids and their names."""
        ids = self._ids(piece)
        return self.whole[ids[0]] if len(ids) == 1 else (len(ids), " ".join(map(str, ids)), " ".join(map(self.transducer.tokens.__getitem__, ids)))

    def encode(self, text: str) -> list[int]:
        of = self.ids
        return [i for p in self.transducer.pieces(text) for i in of[p]]

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, and SHA-256 of the ids and of the decoded text, both fed piece by piece."""
        ids, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
        of, spelled = self.transducer, self.spelled
        decoder = None if of.decoder is None else Decoder(of)
        lead = ""
        # Without a decoder in the file, the decoded text is the names with spaces between.
        for some in chunked(of.pieces(text), DIGEST_PIECES):
            entries = [spelled[p] for p in some]
            n += sum(e[0] for e in entries)
            ids.update((lead + " ".join([e[1] for e in entries])).encode())
            if decoder is None:
                decoded.update((lead + " ".join([e[2] for e in entries])).encode())
            else:
                for e in entries:
                    decoded.update(decoder.feed(map(int, e[1].split())).encode())
            lead = " "
        if decoder is not None:
            decoded.update(decoder.close().encode())
        return n, ids.hexdigest(), decoded.hexdigest()


@functools.lru_cache(maxsize=2)
def transducer_for(path: str) -> Transducer:
    """A worker's transducer, kept from task to task."""
    return Transducer(path)


@contextlib.contextmanager
def encoder_for(path: str) -> Iterator[Encoder]:
    """An encoder for one task; what it has learned of words and pairs goes with it, as workers outlive operators."""
    encoder = Encoder(transducer_for(path))
    try:
        yield encoder
    finally:
        encoder.transducer.fits.clear()
        encoder.transducer.starts.clear()


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, SHA-256 of the ids and of the decoded text. One narrow pass, no shuffle."""

    def run(batches):
        with encoder_for(path) as encoder:
            for part in slices(batches, 1):
                rows = [encoder.digest(t or "") for t in part.column(1).to_pylist()]
                n, ids, texts = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(frugal(run), SCHEMA)


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id and the token ids."""

    def run(batches):
        with encoder_for(path) as encoder:
            for part in slices(batches, 1):
                ids = [encoder.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(frugal(run), "doc_id long, ids array<int>")


def decode_ids(tokens: DataFrame, path: str, plain: bool | None = None) -> DataFrame:
    """Per row of (doc_id, ids): doc_id and the text, decoded incrementally."""

    def run(batches):
        of = transducer_for(path)
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                d = Decoder(of, plain)
                texts.append(d.feed(ids or []) + d.close())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(frugal(run), "doc_id long, text string")
