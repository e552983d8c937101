"""BPE encoding and decoding (operator 8) by a bounded-lookahead streaming transducer.

The BPE encoding of a prefix followed by its last token is again an encoding, so for each position of a piece one
token ends the encoding of the prefix up to there: the one compatible with the token before it (two tokens are
compatible if merging their joined symbols gives those two back). These last tokens form a tree.

Symbols are pushed one by one. A position is live while the symbols after it begin some token of the merge list, which bounds
the lookahead: no token has more symbols than ``lookahead``. Whatever comes later starts at a live position, so what all live
positions descend from is stable: its tokens are emitted and its states forgotten. On ordinary words that is so after a few symbols, and
the states stay few however long a piece is. Every piece takes this way; the results of short ones are remembered in
a table of bounded size.

Texts are read in slices of 64 KB that end at a blank, which no piece reaches over; ids of a slice are handed on together. A stretch without
blanks beyond that is cut before digits, which are pieces of their own, and tokens of a piece that is longer still are handed on as they
become stable. So ids never gather, and what grows with a text is no more than a few copies of its longest stretch. Pieces are what the vocabulary's normalizer and
splitter give. For slices of Latin letters (below U+0200) both are done here by exact equivalents; other slices pass the
library's own normalizer and splitter, and then the same transducer.

Decoding is a state machine over bytes: each id adds the bytes of its name (or, in a byte-level vocabulary, the bytes that it
stands for), and a character is given out once its last byte is there; bytes that can't become one give U+FFFD. Without a
decoder in the vocabulary the library joins names by a space, so the other part of the state is whether a name came before.

Defined cases: null and empty texts have no tokens and decode to the empty text; symbols that the vocabulary lacks are dropped
before merging, as in the library; repeated rows repeat their result; a null doc_id stays null.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Callable
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

CHUNKS = 500_000
#: Rows whose words are learned together.
BATCH = 2048
#: Characters after which a slice of a text ends at the next blank.
SLICE = 1 << 16
#: Ids of a long piece that are handed on together.
HELD = 4096
_BLANK = re.compile("[ \n]")
_LATIN = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ʯ"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Where a slice without blanks is cut: before a digit, which is a piece of its own and which no character before it combines with.
_APART = re.compile("[0-9]")
_PIECE = re.compile(f"'(?:[stmd]|re|ve|ll)|[{_LATIN}]+|[{_NUMBER}]|[^{_LATIN}{_NUMBER}]+")
#: Bytes of texts whose characters all lie below U+0200, without the separators that only str.split() cuts at.
_PLAIN = bytes(b for b in range(0xC8) if not 0x1C <= b <= 0x1F)
_CODECS: dict = {}


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class Transducer:
    """Streaming BPE over the symbols of a piece; tokens are emitted once stable."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.vocab, self.end = vocab, end
        self.rank = {tuple(m): i for i, m in enumerate(merges)}
        size = lambda t: len(t) - len(end) + (1 if len(t) == len(end) else 0) if end and t.endswith(end) else len(t)
        made = {a + b for a, b in self.rank}
        #: Sufficient lookahead: no token covers more symbols, so no later token starts further back.
        self.lookahead = max([1, *(size(t) for t in made)])
        self.joins: dict[tuple, bool] = {}
        self.edges: dict[tuple, list] = {}
        self.never = 1 << 60
        self.split: dict[str, tuple[str, str, int]] = {}
        for (a, b), i in self.rank.items():
            self.split.setdefault(a + b, (a, b, i))
        made_at = {t: i for t, (_, _, i) in self.split.items()}
        #: Whether each merge joins what earlier merges form, so that ranks are also the order in time.
        self.proper = all(made_at.get(a, -1) < i and made_at.get(b, -1) < i for (a, b), i in self.rank.items()) and len(self.split) == len(self.rank)
        self.own: dict[str, bool] = {}
        #: What symbols inside a piece can be: 1 the beginning of a longer token, 2 a token, 3 both.
        self.kinds: dict[str, int] = {}
        singles = {t for t in vocab if len(self.symbols(t)) == 1}
        for t in made | singles:
            body, tail = (t[: -len(end)], True) if end and t.endswith(end) and len(t) > len(end) else (t, False)
            for i in range(1, len(body)):
                self.kinds[body[:i]] = self.kinds.get(body[:i], 0) | 1
            if not tail and t in vocab:
                self.kinds[body] = self.kinds.get(body, 0) | 2
        #: Whether the vocabulary has a symbol for every byte, inside a piece and at its end.
        self.complete = all(c in vocab and c + end in vocab for c in byte_letters())
        #: Tokens emitted before their piece had ended.
        self.settled = 0
        #: The inner symbols of the piece before, and the states after each of them.
        self.before, self.states = "", ([("", 0, [0], 0, 0)], [])

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE: join the pair of lowest rank, leftmost first, until none is left."""
        s = list(symbols)
        while len(s) > 1:
            best = min(((self.rank.get((s[i], s[i + 1]), 1 << 60), i) for i in range(len(s) - 1)))
            if best[0] == 1 << 60:
                break
            i = best[1]
            s[i : i + 2] = [s[i] + s[i + 1]]
        return s

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            bare = token[: -len(self.end)]
            return [*bare[:-1], bare[-1] + self.end]
        return list(token)

    def canonical(self, token: str) -> bool:
        got = self.own.get(token)
        if got is None:
            got = self.own[token] = self.merged(self.symbols(token)) == [token]
        return got

    def spine(self, token: str, right: bool) -> list[tuple[str, int, int]]:
        """The token's edge symbols over time: (symbol, rank that forms it, rank that consumes it)."""
        got = self.edges.get((token, right))
        if got is None:
            if token in self.split:
                a, b, r = self.split[token]
                inner = self.spine(b if right else a, right)
                got = [*inner[:-1], (*inner[-1][:2], r), (token, r, self.never)]
            else:
                got = [(token, -1, self.never)]
            self.edges[token, right] = got
        return got

    def compatible(self, a: str, b: str) -> bool:
        """Whether the joined symbols of two canonical tokens merge back into these two.

        Both sides merge as alone until a pair across the border comes first; that pair exists while both of
        its symbols stand at the border. Of equal pairs, the one further left goes first.
        """
        if not self.proper:
            return self.merged(self.symbols(a) + self.symbols(b)) == [a, b]
        rank, right = self.rank, self.spine(b, False)
        for x, formed, used in self.spine(a, True):
            for y, formed2, used2 in right:
                r = rank.get((x, y))
                if r is not None and formed < r < used and formed2 < r <= used2:
                    return False
        return True

    def fits(self, before: str, token: str) -> bool:
        """Whether a token of the vocabulary can follow ``before`` ('' at a piece's start); remembered in a bounded table."""
        got = self.joins.get((before, token))
        if got is None:
            if len(self.joins) > 200_000:
                self.joins.clear()
            got = self.joins[before, token] = self.canonical(token) and (not before or self.compatible(before, token))
        return got

    def encode(self, piece: str, emit=None) -> list[str]:
        """Tokens of a piece, its last symbol with the end mark; with emit(tokens), they are handed over as they become stable.

        The states after each symbol are kept until the next piece, which goes on from the symbols that both begin with;
        they are dropped once a piece has outgrown the window.
        """
        vocab, end, kinds, joins = self.vocab, self.end, self.kinds.get, self.joins
        ended = True
        if not self.complete:
            ended = piece[-1:] + end in vocab
            piece = "".join([c for c in piece[:-1] if c in vocab]) + (piece[-1:] if ended else "")
        n = len(piece)
        inner = n - 1 if ended and end else n
        before, k = self.before, 0
        if emit is None:
            for a, b in zip(before, piece[:inner]):
                if a != b:
                    break
                k += 1
        # by position, from ``gone`` on: the token that ends there, where it starts, live positions, what is stable, tokens out
        states, out = self.states
        del states[k + 1 :]
        _, _, live, base, n_out = states[k]
        del out[n_out:]
        gone, most = 0, 4 * self.lookahead
        for i in range(k + 1, inner + 1):
            token, start, still = "", i, []
            for j in live:
                part = piece[j:i]
                kind = kinds(part)
                if kind:
                    if kind != 2:
                        still.append(j)
                    if kind != 1 and not token:
                        pair = states[j - gone][0], part
                        if joins[pair] if pair in joins else self.fits(*pair):
                            token, start = part, j
            if not still or i - gone >= most:
                stable = self._common(base, gone, states, token, start, [*still, i]) if still else i
                if stable > base:
                    found = self._path(base, gone, states, token, start, i, stable)
                    if i < n:
                        self.settled += len(found)
                    if emit:
                        emit(found)
                    else:
                        out += found
                    base = stable
            still.append(i)
            live = still
            states.append((token, start, still, base, len(out)))
            if i - gone >= most:
                del states[: base - gone]
                gone = base
        found = []
        if inner < n:
            for j in live:
                token = piece[j:] + end
                if token in vocab and self.fits(states[j - gone][0], token):
                    found = [*self._path(base, gone, states, "", 0, 0, j), token]
                    break
        else:
            found = self._path(base, gone, states, "", 0, 0, n)
        result = out + found
        if emit:
            emit(found)
            result = []
        self.before = piece[:inner]
        if gone or emit:
            self.before, self.states = "", ([("", 0, [0], 0, 0)], [])
        return result

    @staticmethod
    def _path(base: int, gone: int, states: list[tuple], token: str, start: int, at: int, to: int) -> list[str]:
        """The tokens from base to a position; ``token`` from ``start`` ends at the newest position ``at``."""
        path = []
        while to > base:
            if to == at:
                path.append(token)
                to = start
            else:
                path.append(states[to - gone][0])
                to = states[to - gone][1]
        path.reverse()
        return path

    @staticmethod
    def _common(base: int, gone: int, states: list[tuple], token: str, start: int, live: list[int]) -> int:
        """The position that all live ones descend from; the newest one's token begins at ``start``."""
        newest, at = live[-1], set(live)
        while len(at) > 1:
            far = max(at)
            at.remove(far)
            at.add(base if far <= base else start if far == newest else states[far - gone][1])
        return at.pop()


class ByteText:
    """Incremental byte-to-text state machine: the state is what is left of a character, and whether a name came before."""

    def __init__(self, names: dict[int, bytes], between: bytes):
        self.names, self.between = names, between
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: list[int]) -> str:
        names = self.names
        raw = self.between.join([names[i] for i in ids if i in names])
        if not raw:
            return ""
        lead = self.between if self.begun else b""
        self.begun = True
        return self.machine.decode(lead + raw)

    def finish(self) -> str:
        return self.machine.decode(b"", final=True)


class Codec:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.machine = Transducer(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.vocab = dict(model["vocab"])
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        letters = byte_letters()
        byte_level = (whole.get("decoder") or {}).get("type") == "ByteLevel"
        byte_of = {c: b for b, c in enumerate(letters)}
        raw = lambda t: bytes(byte_of[c] for c in t) if byte_level and all(c in byte_of for c in t) else t.encode()
        self.bytes_of = {i: raw(t) for t, i in self.vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.between = b"" if byte_level else b" "
        self.shown = {i: str(i) for i in self.bytes_of}
        self.cut = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.table = str.maketrans({chr(b): x for b, x in enumerate(letters)})
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one plain piece."""
        got = self.words.get(piece)
        if got is None:
            got = self.older.get(piece)
            if got is None:
                raw = piece if piece.isascii() else piece.encode().decode("latin-1")
                vocab = self.vocab
                got = tuple([vocab[t] for t in self.machine.encode(raw.translate(self.table))])
            self.keep(piece, got)
        return got

    def keep(self, chunk: str, ids: tuple[int, ...]) -> None:
        if len(chunk) <= 64:
            if len(self.words) >= CHUNKS:
                self.older = dict(self.words)  # frequent pieces come back from here
                self.words.clear()
            self.words[chunk] = ids

    def chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a run of plain characters between white space."""
        if chunk.isalpha():
            return self.piece(chunk)
        got = self.older.get(chunk)
        if got is None:
            if chunk[:-1].isalpha() and chunk[-1] in ".,":
                got = self.piece(chunk[:-1]) + self.piece(chunk[-1])
            else:
                got = tuple(chain.from_iterable(map(self.piece, _PIECE.findall(chunk))))
        self.keep(chunk, got)
        return got

    def learn(self, texts: list[str | None]) -> None:
        """Fill the table with the words of the texts' first slices in sorted order, in which pieces share their beginnings."""
        words: set[str] = set()
        for text in texts:
            if text:
                words.update(text[:SLICE].lower().split())
        known = self.words
        for word in sorted(words):
            if word not in known and len(word) <= 64 and not word.encode().translate(None, _PLAIN):
                self.chunk(word)

    def ids_of(self, text: str) -> list[int]:
        """Ids of a slice without special tokens."""
        if not text.encode().translate(None, _PLAIN):
            known, chunk = self.words.get, self.chunk
            return list(chain.from_iterable([known(c) or chunk(c) for c in text.lower().split()]))
        pieces = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(text))
        vocab, encode = self.vocab, self.machine.encode
        return [vocab[t] for p, _ in pieces for t in encode(p)]

    def long_piece(self, symbols: str, out: Callable[[list[int]], None]) -> None:
        """Ids of one piece in the vocabulary's letters, handed on as its tokens become stable."""
        vocab, held = self.vocab, []

        def settled(tokens: list[str]) -> None:
            held.extend([vocab[t] for t in tokens])
            if len(held) >= HELD:
                out(held.copy())
                held.clear()

        self.machine.encode(symbols, settled)
        out(held)

    def stretch(self, text: str, out: Callable[[list[int]], None]) -> None:
        """Ids of a text without special tokens that may have no blank for long: in parts that end where pieces do anyway."""
        at = 0
        while at < len(text):
            cut = _APART.search(text, at + SLICE)
            part = text[at : cut.start()] if cut else text[at:]
            at += len(part)
            if len(part) <= 2 * SLICE:
                out(self.ids_of(part))
            elif not part.encode().translate(None, _PLAIN):
                for chunk in part.lower().split():
                    for m in _PIECE.finditer(chunk):
                        raw = m.group()
                        if len(raw) > SLICE:
                            self.long_piece((raw if raw.isascii() else raw.encode().decode("latin-1")).translate(self.table), out)
                        else:
                            out(list(self.piece(raw)))
            else:
                pieces = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part))
                for piece, _ in pieces:
                    self.long_piece(piece, out)

    def encode(self, text: str | None, out: Callable[[list[int]], None]) -> None:
        """Hands the ids of the text on, slice by slice; those of a slice that has no blank for long as they become stable."""
        text, at = text or "", 0
        while at < len(text):
            cut = _BLANK.search(text, at + SLICE)
            part = text[at : cut.end()] if cut else text[at:]
            at += len(part)
            plain = (lambda t: out(self.ids_of(t))) if len(part) <= 2 * SLICE else (lambda t: self.stretch(t, out))
            if self.cut and "<" in part:
                done = 0
                for m in self.cut.finditer(part):
                    plain(part[done : m.start()])
                    out([self.special[m.group()]])
                    done = m.end()
                plain(part[done:])
            else:
                plain(part)

    def trip(self, text: str | None, ids_to: Callable[[str], object], text_to: Callable[[str], object]) -> int:
        """Number of ids; their decimals, joined by a space, and the decoded text are handed on as they come."""
        machine, n, shown = ByteText(self.bytes_of, self.between), 0, self.shown

        def take(ids: list[int]) -> None:
            nonlocal n
            if ids:
                ids_to((" " if n else "") + " ".join([shown[i] for i in ids]))
                n += len(ids)
                text_to(machine.feed(ids))

        self.encode(text, take)
        text_to(machine.finish())
        return n

    def run(self, text: str | None) -> tuple[int, str, str]:
        """(tokens, decimal ids joined by a space, decoded text)."""
        ids, told = [], []
        return self.trip(text, ids.append, told.append), "".join(ids), "".join(told)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(tokens, SHA-256 of the ids, SHA-256 of the decoded text), handed on as they come."""
        ids, told = hashlib.sha256(), hashlib.sha256()
        n = self.trip(text, lambda s: ids.update(s.encode()), lambda s: told.update(s.encode()))
        return n, ids.hexdigest(), told.hexdigest()


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def bpe_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; no shuffle."""

    def rows(names, texts):
        own = codec(tokenizer)
        own.learn(texts)
        out = list(map(own.digest, texts))
        return [names, *([list(c) for c in zip(*out)] if out else [[]] * 3)]

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", BATCH)


def bpe_round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (space-joined) and decoded text of every row: the operator's own output."""

    def rows(names, texts):
        out = [codec(tokenizer).run(t) for t in texts]
        return [names, *([list(c) for c in zip(*out)] if out else [[]] * 3)]

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, n_tokens long, ids string, decoded string")
