"""SentencePiece BPE encoding and decoding by suffix-array matching.

The vocabulary is a given BPE model with byte fallback; nothing is trained.  For a
batch of texts:

1. Blanks become the piece mark and texts fall into units that no piece crosses (a
   run of marks and the letters, or the signs, that follow).
2. The batch's distinct units, joined by separators, are indexed by a suffix array
   (prefix doubling up to the longest piece).
3. Every piece is binary-searched, all pieces at once; its range of the suffix array
   lists its occurrences.  Each is an edge from its first position to its end.
4. Edges are sorted by position and relaxed from left to right: an edge extends the
   path that ends at its start if BPE keeps the path's last piece and the edge's
   piece apart when it encodes the two together.  A sequence of pieces is what BPE
   makes of a text just when this holds for every two neighbours, so exactly one path
   reaches each position, and ids equal those of the merge procedure.
5. A character without a piece of its own is an edge, too, encoded as its bytes.

Decoding concatenates the pieces' bytes, so decode(encode(text)) is the text, but that
the mark character itself (U+2581) comes back as a blank and that bytes which aren't
UTF-8 come back as U+FFFD.

Defined results: null encodes to null, the empty text to no ids; decoding null gives null.
Unknown and control ids decode to nothing; null ids and ids outside the vocabulary raise.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tripmart.llm.common import release_memory

MARK = "▁"
SEPARATOR = 0x110000
#: Characters worked on, and indexed, at one time; texts whose ids leave a task at one time.
CHUNK_CHARS, INDEX_CHARS = 1 << 18, 1 << 17
OUT_TEXTS, OUT_CHARS = 1000, 1 << 21
#: Ids decoded at one time.
DECODE_IDS = 1 << 16
#: Bits of the slots of the memo of pairs; units whose ids a worker remembers between batches.
PAIR_BITS, MEMO_UNITS = 20, 1 << 19
#: ASCII other than letters: a model's pieces seldom join these with letters.
SIGNS = r"\x00-@\[-`{-\x7f"
LETTER = r"[^\W\d_²³¹]"
MIXED = re.compile(f"[{SIGNS}]{LETTER}|{LETTER}[{SIGNS}]")
IS_MARK, IS_LINE, IS_SIGN, IS_LETTER, IS_OTHER = range(5)
_BASES = np.random.default_rng(5).integers(1, 1 << 63, 2, np.uint64) | np.uint64(1)


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, IS_OTHER, np.uint8)
    whole = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    for m in re.finditer(f"{LETTER}+", whole):
        lo, hi = ord(m[0][0]), ord(m[0][-1])
        out[lo:hi + 1] = IS_LETTER
    for m in re.finditer(f"[{SIGNS}]", whole[:128]):
        out[ord(m[0])] = IS_SIGN
    out[ord(MARK)], out[10] = IS_MARK, IS_LINE
    return out


class Vocabulary:
    """Pieces and scores, small enough for a task's closure (about 1 MB)."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], skipped: set[int]):
        self.pieces, self.scores, self.byte_ids, self.skipped = pieces, scores, byte_ids, skipped

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        skipped = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        return cls(pieces, [sp.get_score(i) for i in range(n)], byte_ids, skipped)

    @functools.cached_property
    def score_of(self) -> dict[str, float]:
        out: dict[str, float] = {}
        fallback = set(self.byte_ids.values())
        for i, (p, s) in enumerate(zip(self.pieces, self.scores, strict=True)):
            if i not in self.skipped and i not in fallback:
                out[p] = s
        return out

    @functools.cached_property
    def id_of(self) -> dict[str, int]:
        fallback = set(self.byte_ids.values())
        return {p: i for i, p in enumerate(self.pieces) if i not in self.skipped and i not in fallback}

    @functools.cached_property
    def cuts(self) -> int:
        """How finely units may be cut so that no piece crosses: 2 between letters and signs and
        around line ends, too; 1 before marks; 0 not at all."""
        bare = [p.lstrip(MARK) for p in self.id_of]
        if any(MARK in p for p in bare):
            return 0
        if any("\n" in p and p != "\n" for p in self.id_of) or any(MIXED.search(p) for p in bare):
            return 1
        return 2

    def unit_starts(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where units begin in concatenated texts that begin at ``first``."""
        kind = _classes()[code]
        new = np.zeros(len(code), bool)
        new[first] = True
        if self.cuts:
            mark = kind == IS_MARK
            new[1:] |= mark[1:] & ~mark[:-1]
        if self.cuts > 1:
            line = kind == IS_LINE
            new |= line
            new[1:] |= line[:-1]
            sign, letter = kind == IS_SIGN, kind == IS_LETTER
            new[1:] |= (sign[:-1] & letter[1:]) | (letter[:-1] & sign[1:])
        return np.flatnonzero(new)

    @functools.cached_property
    def matrix(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pieces, longest) code points padded with -1, lengths, ids; sorted by nothing."""
        names = list(self.id_of)
        longest = max(map(len, names))
        out = np.full((len(names), longest), -1, np.int32)
        for i, p in enumerate(names):
            out[i, :len(p)] = [ord(c) for c in p]
        return out, np.array([len(p) for p in names]), np.array([self.id_of[p] for p in names])

    def apart(self, left: str, right: str) -> bool:
        """Whether BPE encodes ``left + right`` as these two pieces."""
        parts = list(left + right)
        score = self.score_of
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts == [left, right]

    def whole(self, piece: str) -> bool:
        """Whether BPE can make this piece at all."""
        for cut in range(1, len(piece)):
            if self.apart(piece[:cut], piece[cut:]):
                return False
        return True

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("pieces", "scores", "byte_ids", "skipped")}

    # ---- batch encoding

    def name(self, token: int) -> str:
        return chr(token - len(self.pieces)) if token >= len(self.pieces) else self.pieces[token]

    def _apart_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``apart`` for arrays of tokens, each pair decided once per worker."""
        if not hasattr(self, "_memo"):
            self._memo = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        slots, answers = self._memo
        width = len(self.pieces) + SEPARATOR
        pair = left.astype(np.int64) * width + right
        slot = ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        ok = answers[slot]
        new = np.flatnonzero(slots[slot] != pair)
        if len(new):
            pairs, at = np.unique(pair[new], return_inverse=True)
            fresh = np.array([self.apart(self.name(p // width), self.name(p % width)) for p in pairs.tolist()])
            ok[new] = fresh[at]
            slots[slot[new]] = pair[new]          # of two pairs with one slot, the later stays ...
            kept = slots[slot[new]] == pair[new]
            answers[slot[new][kept]] = ok[new][kept]      # ... with its own answer
        return ok

    def _encode_indexed(self, code: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each) of the units code[begin:begin + size]."""
        start = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        stop = start + size
        joined = np.full(int(stop[-1]) + 1, SEPARATOR, np.int64)
        offset = np.arange(len(joined)) - np.repeat(start, size + 1)
        inside = np.ones(len(joined), bool)
        inside[stop] = False
        joined[inside] = code[np.repeat(begin, size) + offset[inside]]
        pos, token, length = self._edges(joined)

        # relax: the last piece of the one path that ends at each position
        last = np.full(len(joined) + 1, -1, np.int64)
        back = np.full(len(joined) + 1, -1, np.int64)
        at = offset[pos]
        if size.max() < 1 << 16:
            at = at.astype(np.uint16)               # sorted by radix
        order = np.argsort(at, kind="stable")
        pos, token, length = pos[order], token[order], length[order]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=int(size.max()) + 1))])
        for o in range(len(cuts) - 1):
            a, b = cuts[o], cuts[o + 1]
            p, t, n = pos[a:b], token[a:b], length[a:b]
            if o:
                reached = last[p] >= 0
                p, t, n = p[reached], t[reached], n[reached]
                if not len(p):
                    continue
                ok = self._apart_all(last[p], t)
                p, t, n = p[ok], t[ok], n[ok]
            last[p + n] = t
            back[p + n] = p
        # back from the end of every unit at once
        at, owner = stop.copy(), np.arange(len(size))
        got_token, got_pos, got_owner = [], [], []
        while len(at):
            got_token.append(last[at])
            got_pos.append(back[at])
            got_owner.append(owner)
            at = back[at]
            more = at > start[owner]
            at, owner = at[more], owner[more]
        tokens = np.concatenate(got_token)[np.argsort(np.concatenate(got_pos), kind="stable")]
        owners = np.sort(np.concatenate(got_owner), kind="stable")
        n_pieces = len(self.pieces)
        plain = tokens < n_pieces
        if plain.all():
            return tokens.astype(np.int32), np.bincount(owners, minlength=len(size))
        # characters without a piece become their bytes
        width = np.ones(len(tokens), np.int64)
        bare, at = np.unique(tokens[~plain], return_inverse=True)
        spelled = [[self.byte_ids[x] for x in chr(t - n_pieces).encode("utf-8", "replace")] for t in bare.tolist()]
        width[~plain] = np.array([len(x) for x in spelled])[at]
        first = np.concatenate([[0], np.cumsum(width)[:-1]])
        flat = np.repeat(tokens, width).astype(np.int32)
        for place, i in zip(first[~plain].tolist(), at.tolist(), strict=True):
            flat[place:place + len(spelled[i])] = spelled[i]
        return flat, np.bincount(owners, weights=width, minlength=len(size)).astype(np.int64)

    def _encode_new(self, code, begin, size) -> tuple[np.ndarray, np.ndarray]:
        """The same for any number of units, an index for every INDEX_CHARS characters."""
        if not len(size):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        block = (np.cumsum(size + 1) - size - 1) // INDEX_CHARS
        cut = np.flatnonzero(np.diff(block)) + 1
        got = [self._encode_indexed(code, b, n) for b, n in zip(
            np.split(begin, cut), np.split(size, cut), strict=True)]
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])

    def _encode_chunk(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts whose blanks are marks."""
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.array([len(t) for t in texts])
        text_at = np.concatenate([[0], np.cumsum(length)[:-1]])
        begin = self.unit_starts(code, text_at)
        size = np.diff(np.concatenate([begin, [len(code)]]))
        # two hashes name a unit: together 96 bits
        place = np.arange(len(code)) - np.repeat(begin, size)
        power = np.ones((2, int(size.max())), np.uint64)
        power[:, 1:] = _BASES[:, None]
        np.cumprod(power, axis=1, out=power)
        wide = code.astype(np.uint64) + np.uint64(1)
        key, check = (np.add.reduceat(wide * p[place], begin) for p in power)
        key = key.view(np.int64)
        check = (check >> np.uint64(32)).astype(np.uint32)
        unit, keys = pd.factorize(key)
        first = np.empty(len(keys), np.int64)
        first[unit[::-1]] = np.arange(len(unit) - 1, -1, -1)
        if (check[first][unit] != check).any():         # two units with one 64-bit hash
            unit, first = np.unique(np.stack([key, check.astype(np.int64)]), axis=1, return_index=True,
                                    return_inverse=True)[2:0:-1]
            unit, keys = unit.ravel(), key[first]
        flat, offset, count = self._known(keys, check[first], code, begin[first], size[first])
        n = count[unit]
        ends = np.cumsum(n)
        ids = flat[np.repeat(offset[unit] - (ends - n), n) + np.arange(int(ends[-1]))]
        last_unit = np.searchsorted(begin, text_at + length) - 1
        return np.split(ids, ends[last_unit][:-1])

    def _known(self, keys, checks, code, begin, size) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, offset, count) of each distinct unit.  Units that came early in a worker's
        life are remembered, so its later chunks index only what is new."""
        memo = self.__dict__.setdefault("_units", tuple(np.empty(0, t) for t in (
            np.int64, np.uint32, np.int64, np.int32, np.int32)))
        known, known_check, known_offset, known_count, known_flat = memo
        at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
        hit = (known[at] == keys) & (known_check[at] == checks) if len(known) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~hit)
        ids, counts = self._encode_new(code, begin[new], size[new])
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]]) + len(known_flat) if len(new) else counts
        offset, count = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        offset[hit], count[hit] = known_offset[at[hit]], known_count[at[hit]]
        offset[new], count[new] = starts, counts
        flat = np.concatenate([known_flat, ids])
        room = min(len(new), MEMO_UNITS - len(known))
        if room > 0:
            put = new[:room]
            where = np.searchsorted(known, np.sort(keys[put]))
            order = np.argsort(keys[put], kind="stable")
            self._units = (np.insert(known, where, keys[put][order]), np.insert(known_check, where, checks[put][order]),
                           np.insert(known_offset, where, starts[:room][order]),
                           np.insert(known_count, where, counts[:room][order].astype(np.int32)),
                           flat[:len(known_flat) + int(counts[:room].sum())].copy())
        return flat, offset, count

    def _edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, token, length) of every occurrence of every piece, and of every
        character without a piece of its own."""
        names, lengths, ids = self.matrix
        longest = names.shape[1]
        n = len(text)
        # pieces whose first two characters never follow each other have empty ranges
        seen = np.unique(text[:-1] * (SEPARATOR + 1) + text[1:]) if n > 1 else np.empty(0, np.int64)
        there = np.isin(text_pairs(names), seen) | (lengths == 1)
        names, lengths, ids = names[there], lengths[there], ids[there]
        chars, code = np.unique(text, return_inverse=True)
        bits = int(len(chars) + 1).bit_length()
        packed = h = min(longest, 63 // bits)   # as many characters as one integer holds
        code = np.concatenate([code + 1, np.zeros(h, np.int64)])
        key = np.zeros(n, np.int64)
        for i in range(h):
            key = (key << bits) | code[i:i + n]
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        while h < longest:                      # ranks by the first h characters
            later = np.zeros(n, np.int64)
            later[:max(0, n - h)] = rank[h:] + 1
            rank = np.unique(rank * (n + 2) + later, return_inverse=True)[1].astype(np.int64)
            h *= 2
        order = np.argsort(rank, kind="stable")

        # binary search by the characters that one integer holds, of all pieces at once
        at = np.searchsorted(chars, names)
        digit = np.where(names >= 0, at + 1, 0).astype(np.int64)
        there = ((chars[np.minimum(at, len(chars) - 1)] == names) | (names < 0)).all(1)
        names, lengths, ids, digit = names[there], lengths[there], ids[there], digit[there]
        low = np.zeros(len(names), np.int64)
        high = np.zeros(len(names), np.int64)
        for i in range(packed):
            low = (low << bits) | digit[:, i]
            high = (high << bits) | np.where(lengths > i, digit[:, i], (1 << bits) - 1)
        sorted_key = key[order]
        lo, hi = np.searchsorted(sorted_key, low, "left"), np.searchsorted(sorted_key, high, "right")
        # then, for longer pieces, inside their ranges
        padded = np.concatenate([text, np.full(longest, -1, np.int64)]).astype(np.int32)
        long_ = np.flatnonzero((lengths > packed) & (lo < hi))
        tail = names[long_, packed:]
        used = tail >= 0

        def search(right: bool) -> np.ndarray:
            """First place of the range at or after (after all of) each long piece."""
            a, b = lo[long_].copy(), hi[long_].copy()
            row = np.arange(len(long_))
            while (open_ := a < b).any():
                mid = (a + b) // 2
                here = padded[order[np.minimum(mid, n - 1)][:, None] + np.arange(packed, longest)]
                less, more = (here < tail) & used, (here > tail) & used
                first = (less | more).argmax(1)
                differs = less[row, first] | more[row, first]
                before = np.where(differs, less[row, first], right)
                a, b = np.where(open_ & before, mid + 1, a), np.where(open_ & ~before, mid, b)
            return a

        if len(long_):
            lo[long_], hi[long_] = search(False), search(True)
        found = hi - lo
        total = int(found.sum())
        into = np.repeat(lo - np.concatenate([[0], np.cumsum(found)[:-1]]), found) + np.arange(total)
        pos = order.astype(np.int32)[into]
        token, length = np.repeat(ids.astype(np.int32), found), np.repeat(lengths.astype(np.int32), found)
        single = np.zeros(n, bool)
        single[pos[length == 1]] = True
        bare = np.flatnonzero(~single & (text != SEPARATOR))
        return (np.concatenate([pos, bare.astype(np.int32)]),
                np.concatenate([token, (text[bare] + len(self.pieces)).astype(np.int32)]),
                np.concatenate([length, np.ones(len(bare), np.int32)]))

    def encode(self, texts) -> list[np.ndarray | None]:
        """Ids of every text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        held, who, chars = [], [], 0

        def flush():
            for i, ids in zip(who, self._encode_chunk(held), strict=True):
                out[i] = ids if out[i] is None else np.concatenate([out[i], ids])

        for i, text in enumerate(texts):
            if not isinstance(text, str):
                continue
            if not text:
                out[i] = np.empty(0, np.int32)
                continue
            for part in _parts(MARK + text.replace(" ", MARK)) if self.cuts else (MARK + text.replace(" ", MARK),):
                held.append(part)
                who.append(i)
                chars += len(part)
                if chars >= CHUNK_CHARS:
                    flush()
                    held, who, chars = [], [], 0
        if held:
            flush()
        return out

    # ---- decoding

    @functools.cached_property
    def bytes_of(self) -> tuple[np.ndarray, np.ndarray]:
        fallback = {i: b for b, i in self.byte_ids.items()}
        each = [b"" if i in self.skipped else bytes([fallback[i]]) if i in fallback
                else p.replace(MARK, " ").encode("utf-8") for i, p in enumerate(self.pieces)]
        return np.frombuffer(b"".join(each), np.uint8), np.concatenate([[0], np.cumsum([len(e) for e in each])])

    def decode(self, ids) -> str | None:
        if ids is None:
            return None
        flat, offsets = self.bytes_of
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.pieces)):
            raise ValueError("an id outside the vocabulary")
        spelled = []
        for lo in range(0, len(ids), DECODE_IDS):
            part = ids[lo:lo + DECODE_IDS]
            n = offsets[part + 1] - offsets[part]
            shift = offsets[part] - np.concatenate([[0], np.cumsum(n)[:-1]])
            spelled.append(flat[np.repeat(shift, n) + np.arange(int(n.sum()))].tobytes())
        text = b"".join(spelled).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def text_pairs(names: np.ndarray) -> np.ndarray:
    """The first two characters of every piece, as one number."""
    return names[:, 0].astype(np.int64) * (SEPARATOR + 1) + names[:, min(1, names.shape[1] - 1)]


def _parts(text: str):
    """A very long text in parts that begin with a mark after another character."""
    at = 0
    while len(text) - at > 4 * CHUNK_CHARS:
        end = text.find(MARK, at + CHUNK_CHARS)
        while end >= 0 and text[end - 1] == MARK:
            end = text.find(MARK, end + 1)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def encoder(vocabulary: Vocabulary):
    """A column function: text -> struct(ids array<int>, exact boolean); ``exact`` tells
    whether the ids decode to the text (null for null)."""
    @F.pandas_udf("ids array<int>, exact boolean")
    def column(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # a slice ends with the text that brings it to OUT_CHARS
            length = batch.str.len().fillna(0).to_numpy(np.int64)
            block = (np.cumsum(length) - length) // OUT_CHARS
            cuts = np.flatnonzero(np.diff(block)) + 1
            ends = sorted({*range(0, len(batch), OUT_TEXTS), *cuts.tolist(), len(batch)})
            for lo, hi in zip(ends, ends[1:], strict=False):
                texts = batch.iloc[lo:hi].tolist()
                ids = vocabulary.encode(texts)
                exact = [None if t is None else vocabulary.decode(i) == t for t, i in zip(texts, ids, strict=True)]
                yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "exact": pd.Series(exact, dtype=object)})
                release_memory()
    return column


def decoder(vocabulary: Vocabulary):
    """A column function: array<int> of ids -> text."""
    @F.pandas_udf("string")
    def column(ids: pd.Series) -> pd.Series:
        return pd.Series([vocabulary.decode(x) for x in ids], dtype=object)
    return column
