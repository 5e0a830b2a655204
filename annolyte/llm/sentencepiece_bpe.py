"""SentencePiece BPE encoding by backtracking, and decoding.

Per unit of text (a run of U+2581 with the characters up to the next run; no piece crosses such a
border) the longest piece at each position comes from an Aho-Corasick automaton. A piece may
follow another only if merging both their characters anew gives just the two; where no piece
fits, the position is marked in a bitfield of failed positions and the last piece is taken
back for its next shorter one. Only in a run of two or more U+2581, whose pieces share one score, is the run itself
merged directly; the word behind it is encoded by backtracking too, and the border is checked by re-merging.

Decoding joins the pieces of a text's ids; texts with other ids (bytes above 127, unknown, control) go through `decode`.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mapped, parts_by_size

#: The library's white-space mark: fixed value.
SPACE = "▁"
#: Words and pairs of pieces that a worker remembers at most.
WORDS, PAIRS = 600_000, 400_000
#: Bytes of texts that are encoded at once; a longer text is alone.
PART = 1 << 21


class BpeModel:
    """The pieces of a model file, with exact encode and decode as the library does them."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with the identity normaliser is needed")
        self.prefix = norm.add_dummy_prefix
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.bytes = [0] * 256
        self.pieces = [p.piece for p in model.pieces]
        self.byte_of = {}
        self.silent = set()
        self.unk, self.unk_surface = 0, train.unk_surface
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.bytes[b := int(p.piece[3:5], 16)] = i
                self.byte_of[i] = b
            elif p.type == 2:
                self.unk = i
            elif p.type == 3:
                self.silent.add(i)
            elif p.type == 1:
                if SPACE in p.piece[1:] and p.piece.strip(SPACE):
                    raise ValueError("a piece crosses a word border")
                self.id[p.piece] = i
                self.score[p.piece] = p.score
            else:
                raise ValueError("user-defined and unused pieces are not supported")
        self.fallback = train.byte_fallback
        self.chars = {p for p in self.id if len(p) == 1}
        self.find = ahocorasick.Automaton()
        for p in self.id:
            self.find.add_word(p, len(p))
        self.find.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        #: By unit: its ids, and the same as decimals joined by commas.
        self.words: dict[str, tuple[tuple[int, ...], str]] = {}
        #: What an id adds to a text, where that doesn't depend on its neighbours.
        plain = [p.replace(SPACE, " ") if p in self.id else None for p in self.pieces]
        for i, b in self.byte_of.items():
            if b < 128:
                plain[i] = chr(b)
        self.plain = pa.array(plain, pa.string())

    def merge(self, text: str) -> list[str]:
        """Merging by score, leftmost first among equals."""
        score = self.score
        n = len(text)
        sym: list[str | None] = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-s, i, 2) for i in range(n - 1) if (s := score.get(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            a = sym[i]
            j = after[i]
            if a is None or j >= n or len(a) + len(sym[j]) != size:
                continue
            a = sym[i] = a + sym[j]
            sym[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := score.get(a + sym[k])) is not None:
                    heapq.heappush(heap, (-s, i, size + len(sym[k])))
            h = before[i]
            if h >= 0 and (s := score.get(sym[h] + a)) is not None:
                heapq.heappush(heap, (-s, h, size + len(sym[h])))
        return [x for x in sym if x is not None]

    def follows(self, a: str, b: str) -> bool:
        """Whether merging the characters of a and b gives a, then b."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            known = self.fits[a, b] = self.merge(a + b) == [a, b]
        return known

    def split(self, unit: str) -> list[str]:
        """The pieces and unknown characters of one unit."""
        if unit.startswith(SPACE * 2):
            return self._after_run(unit)
        n = len(unit)
        longest = [0] * (n + 1)
        for end, size in self.find.iter(unit):  # ends ascend, so the longest piece from a start comes last
            longest[end + 1 - size] = size
        fits = self.fits
        failed = 0
        out: list[str] = []
        pos, last, size = 0, "", longest[0]
        while pos < n:
            if not longest[pos]:  # a character without a piece stands alone, on either side
                last = unit[pos]
                out.append(last)
                pos += 1
                size = longest[pos]
                continue
            while size:
                end = pos + size
                if not failed >> end & 1:
                    piece = unit[pos:end]
                    if not last or (ok := fits.get((last, piece))) or ok is None and self.follows(last, piece):
                        out.append(piece)
                        pos, last, size = end, piece, longest[end]
                        break
                size = self._shorter(unit, pos, size)
            else:
                failed |= 1 << pos
                if not out:
                    raise AssertionError(f"no encoding of {unit!r}")
                size = len(out.pop())
                pos -= size
                last = out[-1] if out else ""
                size = self._shorter(unit, pos, size)
        return out

    def _after_run(self, unit: str) -> list[str]:
        """A run of SPACE, merged, and the word behind it, which may take the run's last character."""
        word = unit.lstrip(SPACE)
        run = unit[: len(unit) - len(word)]
        if not word:
            return self.merge(run)
        behind = self.split(SPACE + word)
        if behind[0] == SPACE:
            behind = behind[1:]
        else:
            run = run[:-1]
        before = self.merge(run)
        if self.merge(run + behind[0]) != [*before, behind[0]]:
            raise ValueError("this model's runs of spaces can't be parted from words")
        return before + behind

    def _shorter(self, unit: str, pos: int, size: int) -> int:
        """The size of the next shorter piece at pos, or 0."""
        for k in range(size - 1, 0, -1):
            if unit[pos : pos + k] in self.id:
                return k
        return 0

    def _ids(self, unit: str) -> list[int]:
        ids: list[int] = []
        for p in self.split(unit):
            i = self.id.get(p)
            if i is not None:
                ids.append(i)
            elif self.fallback:
                ids += [self.bytes[b] for b in p.encode()]
            else:
                ids.append(self.unk)
        return ids

    def _cut(self, text: str) -> list[str]:
        """Units of a text; a unit starts where a run of SPACE starts."""
        text = text.replace(" ", SPACE)
        if self.prefix:
            text = SPACE + text
        parts = text.split(SPACE)
        units = [parts[0]] if parts[0] else []
        if "" not in parts[1:]:
            units += [SPACE + x for x in parts[1:]]
            return units
        run = 0
        for x in parts[1:]:
            run += 1
            if x:
                units.append(SPACE * run + x)
                run = 0
        if run:
            units.append(SPACE * run)
        return units

    def encode(self, text: str) -> list[int]:
        return [i for unit in self._cut(text) for i in self._ids(unit)] if text else []

    def _known(self, unit: str) -> tuple[tuple[int, ...], str]:
        """A unit's ids and their decimals; short units are remembered."""
        ids = tuple(self._ids(unit))
        found = ids, ",".join(map(str, ids))
        if len(unit) <= 64:
            if len(self.words) > WORDS:
                self.words.clear()
            self.words[unit] = found
        return found

    def round_trip(self, text: str) -> tuple[str, int, str]:
        """The ids as decimals joined by commas, their number, and the text that decoding them gives."""
        if not text:
            return "", 0, ""
        got = [self.words.get(u) or self._known(u) for u in self._cut(text)]
        ids = [i for g in got for i in g[0]]
        return ",".join([g[1] for g in got]), len(ids), self.decode(ids)

    def round_trips(self, texts: pa.Array) -> tuple[list[str], np.ndarray, list[str]]:
        """round_trip of many texts, without nulls, by columns: equal words are encoded once, and all ids looked up at once."""
        out_ids, counts, out_text = [""] * len(texts), np.zeros(len(texts), np.int64), [""] * len(texts)
        plain = pc.invert(pc.match_substring_regex(texts, f"^$|^ | $|  |{SPACE}")).to_numpy(zero_copy_only=False) & self.prefix
        for i in np.flatnonzero(~plain).tolist():
            out_ids[i], counts[i], out_text[i] = self.round_trip(texts[i].as_py())
        rows = np.flatnonzero(plain)
        if not len(rows):
            return out_ids, counts, out_text
        words = pc.split_pattern(texts.take(pa.array(rows)), " ")
        at = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        got = [self.words.get(u) or self._known(u) for u in map(SPACE.__add__, coded.dictionary.to_pylist())]
        which = coded.indices
        sizes = np.fromiter((len(g[0]) for g in got), np.int32, len(got))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array([i for g in got for i in g[0]], pa.int32()))
        ids = lists.take(which).flatten()
        ends = np.r_[0, np.cumsum(sizes[which.to_numpy()])][at].astype(np.int32)
        decimals = pc.binary_join(pa.ListArray.from_arrays(words.offsets, pa.array([g[1] for g in got]).take(which)), ",").to_pylist()
        # A text with any other id joins to null.
        decoded = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), self.plain.take(ids)), "").to_pylist()
        for n, i in enumerate(rows.tolist()):
            out_ids[i], counts[i] = decimals[n], ends[n + 1] - ends[n]
            text = decoded[n]
            if text is None:
                text = self.decode(ids[int(ends[n]) : int(ends[n + 1])].to_pylist())
            elif text[:1] == " ":  # the dummy prefix
                text = text[1:]
            out_text[i] = text
        return out_ids, counts, out_text

    def decode(self, ids: Iterator[int]) -> str:
        """As the library decodes ids: byte pieces form UTF-8, bad bytes U+FFFD; the dummy prefix goes."""
        out: list[str] = []
        run = bytearray()
        first = self.prefix
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(_utf8(run))
                run, first = bytearray(), False
            if i in self.silent:
                continue
            if i == self.unk:
                out.append(self.unk_surface)
                first = False
                continue
            piece = self.pieces[i]
            if first:
                piece, first = piece.removeprefix(SPACE), False
            out.append(piece)
        if run:
            out.append(_utf8(run))
        return "".join(out).replace(SPACE, " ")


def _utf8(run: bytearray) -> str:
    """Each byte that starts no valid character becomes U+FFFD."""
    text, at = [], 0
    raw = bytes(run)
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                text.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                pass
        else:
            text.append("�")
            at += 1
    return "".join(text)


_MODELS: dict[str, BpeModel] = {}


def model(path: str) -> BpeModel:
    """The model of a file, loaded once in each worker."""
    if path not in _MODELS:
        _MODELS[path] = BpeModel(path)
    return _MODELS[path]


def encode_batches(path: str, key: str, text: str, digest: bool):
    """For mapInArrow over (key, text): ids as a list, or their number and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for part in parts_by_size(batches, 1, PART):
            keys, texts = part.column(0), part.column(1).fill_null("")
            if not digest:
                yield pa.RecordBatch.from_arrays([keys, pa.array([m.encode(t) for t in texts.to_pylist()], pa.list_(pa.int32()))], [key, "ids"])
                continue
            ids, counts, back = m.round_trips(texts)
            hexed = [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in made]) for made in (ids, back)]
            yield pa.RecordBatch.from_arrays([keys, pa.array(counts), *hexed], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_texts(docs, path: str, id_col: str = "doc_id", text_col: str = "text"):
    """id, ids: the pieces of each whole text, without begin or end ids.

    Null texts count as empty; empty texts have no ids. Rows pass one by one: repeated rows and null
    ids stay as they are, and no other column is read.
    """
    from pyspark.sql import functions as F

    kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]
    return mapped(docs.select(id_col, text_col), encode_batches(path, id_col, text_col, False), f"`{id_col}` {kind}, ids array<int>")


def encoding_digests(docs, path: str, id_col: str = "doc_id", text_col: str = "text"):
    """id, n_tokens, ids_sha256, decoded_sha256 of each whole text; as encode_texts, then decode."""
    from pyspark.sql import functions as F

    kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]
    return mapped(docs.select(id_col, text_col), encode_batches(path, id_col, text_col, True), f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
