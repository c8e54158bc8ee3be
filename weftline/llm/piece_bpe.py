"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

Each prefix of a word has exactly one last token in its encoding. Going through the word, an automaton yields the
pieces that end at a position; the one that fits is that whose predecessor, the last token of the remaining
prefix, may stand before it: encoding the two as one text must give the same two tokens. The ids are then
recovered backwards from the table. Words are parts of the text that no piece can reach across.
"""

from __future__ import annotations

import codecs
import re

SPACE = "▁"
#: Words whose encoding a worker remembers; when full, the older half goes.
REMEMBERED = 400_000
_NONE = -1
#: Each byte that is not part of a valid character becomes one U+FFFD.
codecs.register_error("weftline_each", lambda e: ("\ufffd" * (e.end - e.start), e.end))


def _varint(b: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (b[i] & 127) << shift
        i, shift = i + 1, shift + 7
        if b[i - 1] < 128:
            return n, i


def _fields(b: bytes):
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        if tag & 7 == 0:
            v, i = _varint(b, i)
        else:
            n = {1: 8, 5: 4}.get(tag & 7)
            if n is None:
                n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        yield tag >> 3, v


def model_parts(data: bytes) -> tuple[list[tuple[str, float, int]], dict[int, object], dict[int, object]]:
    """Pieces (text, score, kind), and the trainer's and the normaliser's settings, of a serialised model."""
    import struct

    pieces, trainer, normaliser = [], {}, {}
    for k, v in _fields(data):
        if k == 1:
            f = dict(_fields(v))
            pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, 1)))
        elif k == 2:
            trainer = dict(_fields(v))
        elif k == 3:
            normaliser = dict(_fields(v))
    return pieces, trainer, normaliser


#: A word's number of ids, its ids as text, its ids, and what they add to a decoded text.
Word = tuple[int, str, tuple[int, ...], str]


class PieceBPE:
    """Encoder and decoder of one model file: BPE, byte fallback, identity normaliser, spaces kept and escaped."""

    def __init__(self, data: bytes) -> None:
        import ahocorasick

        pieces, trainer, normaliser = model_parts(data)
        if trainer.get(3) != 2 or not trainer.get(35) or normaliser.get(2) or normaliser.get(4, 1):
            raise ValueError("only BPE models with byte fallback, no character map and kept spaces are supported")
        self.dummy = bool(normaliser.get(3, 1))
        self.pieces = [p for p, _, _ in pieces]
        self.score = [s for _, s, _ in pieces]
        #: What each id adds to a decoded text; bytes over 127 as the lone surrogates that stand for bytes in Python.
        self.texts = ["" if k == 3 else " \u2047 " if k == 2 else p if k != 6 else chr(b if (b := int(p[3:5], 16)) < 128 else 0xDC00 + b) for p, _, k in pieces]
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == 1}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == 6}
        self.end = next(i for i, (p, _, _) in enumerate(pieces) if p == "</s>")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.chars = {c for p in self.ids for c in p}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("a piece has a space after another character")
        if "\n" in self.chars:
            raise ValueError("a piece has a line feed")
        # No piece goes on after a letter or digit into one of these, into a space, or across a line feed.
        after = {p[i + 1] for p in self.ids for i in range(len(p) - 1) if p[i].isalnum()}
        stops = re.escape("".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in after))
        self.cut = re.compile(rf"{SPACE}*[^\W_]+(?=[{stops}{SPACE}\n]|\Z)|{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        #: By left token (the last entry: no token), which right tokens are known to fit or not.
        self.fits: list[dict[int, bool]] = [{} for _ in range(len(pieces) + 1)]
        self.fitted = 0
        self.remembered = REMEMBERED
        self.young: dict[str, Word] = {}
        self.old: dict[str, Word] = {}

    def merged(self, text: str) -> list[int]:
        """Ids by merging: of the adjacent pairs that form a piece, the best scored, leftmost first. Quadratic; for short texts."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids.get(p, _NONE) for p in parts]

    def _own(self, token: int) -> bool:
        """Whether a piece's own text encodes as that piece."""
        return self.merged(self.pieces[token]) == [token]

    def fit(self, left: int, right: int) -> bool:
        """Whether two tokens may stand side by side; the first is _NONE at the start."""
        if (known := self.fits[left].get(right)) is None:
            if left == _NONE:
                known = self._own(right)
            else:
                known = self.merged(self.pieces[left] + self.pieces[right]) == [left, right]
            if self.fitted > 2_000_000:
                self.fitted = 0
                for x in self.fits:
                    x.clear()
            self.fitted += 1
            self.fits[left][right] = known
        return known

    def word_ids(self, word: str) -> list[int]:
        """Ids of a word that no piece reaches out of."""
        if word in self.ids and self.fit(_NONE, self.ids[word]):
            return [self.ids[word]]
        if not self.chars.issuperset(word):
            out: list[int] = []
            for run in re.findall("[%s]+|." % re.escape("".join(c for c in set(word) if c in self.chars)) if any(c in self.chars for c in word) else ".", word, re.S):
                out += self.word_ids(run) if run[0] in self.chars else [self.bytes[b] for b in run.encode("utf-8", "surrogatepass")]
            return out
        n = len(word)
        last = [_NONE] * (n + 1)
        size = [0] * (n + 1)
        fits = self.fits
        for e, (token, m) in self.automaton.iter(word):  # by end; one of them fits
            e += 1
            if not size[e]:
                left = last[e - m]
                known = fits[left].get(token)
                if known is None:
                    known = self.fit(left, token)
                if known:
                    last[e] = token
                    size[e] = m
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids

    def known(self, word: str) -> Word:
        """A word's encoding, remembered if the word is short."""
        got = self.old.get(word)
        if got is None:
            ids = self.word_ids(word)
            text = "".join([self.texts[i] for i in ids])
            got = (len(ids), " ".join(map(str, ids)), tuple(ids), word if text == word else text)
        if len(word) <= 64:
            if len(self.young) >= self.remembered // 2:
                self.old, self.young = self.young, {}
            self.young[word] = got
        return got

    def parts(self, text: str) -> list[Word]:
        return [self.young.get(w) or self.known(w) for w in self.words(text)]

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        return self.cut.findall((SPACE if self.dummy else "") + text.replace(" ", SPACE))

    def encode(self, text: str, end: bool = True) -> list[int]:
        ids = [i for p in self.parts(text) for i in p[2]]
        return [*ids, self.end] if end else ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control pieces are nothing, runs of byte pieces are UTF-8, one leading space is dropped."""
        return self.finished("".join([self.texts[i] for i in ids]))

    def finished(self, text: str) -> str:
        """A decoded text from what its ids add one after the other, be it id by id or word by word."""
        if not text.isascii():
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "weftline_each")
        if self.dummy and text[:1] == SPACE:
            text = text[1:]
        return text.replace(SPACE, " ")


_models: dict[str, PieceBPE] = {}


def model(path: str) -> PieceBPE:
    """The model of a file, read once a process."""
    from weftline.llm.common import keeps

    if path not in _models:
        with open(path, "rb") as f:
            _models[path] = PieceBPE(f.read())
    keeps(__name__, _models.clear)
    return _models[path]


def encoded(docs, model_path: str, carry: list[str], text: str = "text", ids: bool = False, remembered: int = REMEMBERED):
    """For each row: carried columns, n_tokens, ids_sha256, decoded_sha256, and with ids=True the ids and decoded text.

    Null texts count as empty: the end id only. The model file must be readable at model_path on every executor
    (it belongs to an installed package). No shuffle; a worker remembers about `remembered` words (some 350 bytes each).
    """
    import hashlib

    from weftline.llm.common import map_texts

    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>, decoded string" if ids else "")

    def make():
        bpe = model(model_path)
        bpe.remembered = remembered
        end = str(bpe.end)
        plain: dict[str, str] = {}

        def work(texts):
            got: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "token_ids", "decoded")}
            for t in texts:
                parts = bpe.parts((t or b"").decode("utf-8", "replace"))
                got["n_tokens"].append(sum(p[0] for p in parts) + 1)
                got["ids_sha256"].append(hashlib.sha256(" ".join([*[p[1] for p in parts], end]).encode()).hexdigest())
                decoded = bpe.finished("".join([p[3] for p in parts]))
                got["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if ids:
                    got["token_ids"].append([i for p in parts for i in p[2]] + [bpe.end])
                    got["decoded"].append(decoded)
            return got

        return work

    return map_texts(docs, text, carry, out, make)
