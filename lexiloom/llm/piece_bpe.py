"""Exact piece BPE over short segments of text, for vocabularies of SentencePiece's BPE kind with byte fallback.

No piece of such a vocabulary holds the blank mark after another character, so no merge crosses from a word to the blank
that follows it: a text is the concatenation of segments (blanks, then a word), each encoded on its own. A segment's last
token is the one candidate piece that, put after the encoding of what stands before it, survives when the two are encoded
together; that is what `follows` decides, and both the prefix tables and the lattice relaxation rest on it."""

from __future__ import annotations

import re

BLANK = "▁"
#: Characters before a position by which its candidate pieces are kept.
NEAR = 5
SEGMENT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def segments(text: str | None) -> list[str]:
    """The segments of a text, behind the blank that the vocabulary's normalizer puts first; none for an empty text."""
    return SEGMENT.findall(BLANK + text.replace(" ", BLANK)) if text else []


class PieceBpe:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(self.names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        skip = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.ids = {self.names[i]: i for i in range(n) if not skip[i]}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece crosses from a word to a blank; segments would not be independent")
        probe = "a  b ﬁ\n c "
        if sp.decode(sp.encode(probe)) != probe or sp.encode("a", out_type=str)[0][0] != BLANK:
            raise ValueError("this vocabulary's normalizer changes texts")
        value = {i: b for b, i in self.byte_id.items()}
        self.raw = [bytes([value[i]]) if i in value else b"" if skip[i] else self.names[i].replace(BLANK, " ").encode() for i in range(n)]
        #: Neighbouring characters that some piece holds; between any others no merge ever happens, so a text can be cut there.
        self.inner = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        #: Pieces of more than NEAR characters by their last NEAR, longest first.
        self._long: dict[str, list[tuple[str, int]]] = {}
        for p in sorted(self.ids, key=len, reverse=True):
            if len(p) > NEAR:
                self._long.setdefault(p[-NEAR:], []).append((p, len(p)))
        self._near: dict[str, list[tuple[str, int]]] = {}
        self._parts: dict[str, list[int]] = {}
        self._pairs: dict[tuple[str, str], bool] = {}
        self._stable: dict[str, bool] = {}

    def merge(self, text: str) -> list[str]:
        """The merges spelled out, for a few characters: of all neighbours whose concatenation is a piece, the best-scored
        (leftmost of equals) joins first."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stable(self, piece: str) -> bool:
        """Whether the merges ever produce this piece from its own characters."""
        known = self._stable.get(piece)
        if known is None:
            known = self._stable[piece] = self.merge(piece) == [piece]
        return known

    def follows(self, a: str, b: str) -> bool:
        """Whether a and b stay two tokens when encoded together."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) > 400_000:
                self._pairs.clear()
            known = self._pairs[a, b] = self.merge(a + b) == [a, b]
        return known

    def ending(self, near: str) -> list[tuple[str, int]]:
        """The stable pieces of two characters or more that may end a text whose last NEAR characters (or fewer, where the
        text is no longer) are these, longest first."""
        found = self._long.get(near, ()) if len(near) == NEAR else ()
        found = [(p, n) for p, n in found if self.stable(p)]
        found += [(near[k:], len(near) - k) for k in range(len(near) - 1) if near[k:] in self.ids and self.stable(near[k:])]
        if len(self._near) > 200_000:
            self._near.clear()
        self._near[near] = found
        return found

    def tabulate(self, part: str) -> list[int]:
        """Token count of every prefix: that of the prefix before its last token, and the last token's width. The last token
        is the longest piece that stays whole behind the last token of what stands before it."""
        last, counts = ["", part[0]], [0, self.width(part[0])]
        near, pairs = self._near, self._pairs
        for end in range(2, len(part) + 1):
            key = part[end - NEAR : end] if end > NEAR else part[:end]
            found = near.get(key)
            if found is None:
                found = self.ending(key)
            for piece, size in found:
                start = end - size
                if size > NEAR and (start < 0 or not part.startswith(piece, start)):
                    continue
                if not start:
                    break
                both = (last[start], piece)
                if pairs.get(both) or both not in pairs and self.follows(*both):
                    break
            else:
                piece, start = part[end - 1], end - 1
                last.append(piece)
                counts.append(counts[start] + self.width(piece))
                continue
            last.append(piece)
            counts.append(counts[start] + 1)
        return counts

    def width(self, token: str) -> int:
        """Ids that a token takes: one, or its bytes where no piece has the character."""
        return 1 if token in self.ids else len(token.encode("utf-8", "surrogatepass"))

    def parts(self, segment: str) -> list[str]:
        """The segment cut wherever no piece spans the border."""
        inner, out, begin = self.inner, [], 0
        for k in range(1, len(segment)):
            if segment[k - 1 : k + 1] not in inner:
                out.append(segment[begin:k])
                begin = k
        out.append(segment[begin:])
        return out

    def _part_counts(self, part: str) -> list[int]:
        known = self._parts.get(part)
        if known is None:
            known = self.tabulate(part)
            if len(part) <= 40:
                if len(self._parts) > 200_000:
                    self._parts.clear()
                self._parts[part] = known
        return known

    def prefix_counts(self, segment: str) -> list[int]:
        """Token count of every prefix of a segment, the empty one first."""
        parts = self.parts(segment)
        if len(parts) == 1:
            return self.tabulate(segment)
        out = [0]
        for part in parts:
            base = out[-1]
            out += [base + c for c in self._part_counts(part)[1:]]
        return out

    def token_ids(self, token: str) -> list[int]:
        found = self.ids.get(token)
        return [found] if found is not None else [self.byte_id[b] for b in token.encode("utf-8", "surrogatepass")]

    def decode(self, ids) -> str:
        """The text of token ids; bytes that are no UTF-8 read as U+FFFD."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


_loaded: dict[str, PieceBpe] = {}


def vocabulary(path: str) -> PieceBpe:
    """One copy per Python worker."""
    if path not in _loaded:
        _loaded[path] = PieceBpe(path)
    return _loaded[path]
