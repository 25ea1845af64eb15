"""Lexical tokens of lines, and their shape and context features."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

#: Names whose values are secrets.
STRONG = re.compile(
    r"pass(?:word|wd|phrase)|(?<![a-z])pass(?![a-z])|smtppass|pwd(?![a-z])|secret|credential|api[._-]?key"
    r"|(?:access|auth|private|session|refresh|bearer)[._-]?token(?![a-z])|(?:signing|encryption|salt|private|master|shared|webhook|account)[._-]?key(?![a-z])|x-auth|authorization",
    re.I,
)
_WEAK_WORDS = "key keys token login logged user auth valid curl -u".split()
_WEAK, _WEAK_WORDS = re.compile(rf"^(?:{'|'.join(_WEAK_WORDS)})$", re.I), frozenset(_WEAK_WORDS)
_HASH = re.compile(
    r"digest|checksum|(?<![a-z])sha\d*(?![a-z])|md5|hash|commit|revision|(?:trace|request)[._-]?id|uuid|(?:^|[._-])id$|(?-i:[a-z]Id$)|etag|icon|image|base64|fingerprint|nonce|integrity|pattern|regex",
    re.I,
)
#: Names of what is said about a secret.
_TOLD = re.compile(r"[._-](?:label|prompt|hint|title|message|description|error|help)s?$|(?:Label|Prompt|Hint|Title|Message|Description|Error|Help)s?$", re.M)
_READER = frozenset("read getenv environ env get next_token lookup fetch load resolve process vault getOrDefault os System".split())
_OPEN_END = re.compile(r"(?:[,(\[{=:+`>|]|>-|\|-|\"\"\"|''')\s*$")
_OPEN_LAST = frozenset(",([{=:+`>|-\"'")
#: Words that make a quoted text prose.
_GLUE = frozenset(
    "a an the is are was be must not no of for to in on at by with from your you we it its this that and or if when please enter invalid missing wrong failed unknown expected required cannot can should does do has have empty "
    "der die das ist nicht und fehlt le la les est pas et un une el los es y por con".split()
)
#: Characters over which a name on a line speaks for what follows it; ordinary lines are shorter.
_REACH = 1_000
#: Longer texts are not kept by the caches.
_KEPT = 200
_PIECES_KEPT = 400_000

_QUOTED = r"\"(?:[^\"\\\n]++|\\.)++\"|(?<!\w)'(?:[^'\\\n]++|\\.)++'(?!\w)|'[^\s\"'`\\]+'|`[^\s\"'`\\]+`"
#: No two parts begin alike but a quoted text and its mark, and a key's mark and the dashes (a run as
#: well), so the most frequent come first.
_LEX = re.compile(
    r"(?P<run>(?:[^\s\"'`(){}\[\],;|<>\-]++|-(?!----))++)|(?P<bracket>[(){}\[\],;|<>])"
    rf"|(?P<quoted>{_QUOTED})|(?P<mark>[\"'`])|(?P<pem>-----(?:BEGIN|END) [A-Z0-9 ]+-----)|-----"
)
#: The pieces that ``_LEX`` reads as one, without their names.
_PIECES = re.compile(re.sub(r"\?P<\w+>", "?:", _LEX.pattern))
_QUOTES = frozenset("\"'`")
_MARKS = frozenset("\"'`(){}[],;|<>")
_URL = re.compile(r"(?:[A-Za-z][\w+.\-]*:)?[A-Za-z][\w+.\-]*://")
_USER = re.compile(r"([^:@/?#]*):([^@/]*)@")
_ASSIGN = re.compile(r"(-{0,2}[A-Za-z_][\w.\-]*)(:=|=|:)(?=.)(?!=+$)(?!//)")
_QUOTED_ASSIGN = re.compile(r"[A-Za-z_][\w.\-]*=[^=]")
_QUERY = re.compile(r"[?&;]")

_PLACEHOLDER = re.compile(
    r"example|changeme|change[_-]me|redacted|dummy|placeholder|your[_-]|replace[_-]?me|x{4,}|\*{4,}|\.{3}|^<.*>$|^\$\w|\$\{|%\(|\{\{|\{\w*\}|^%s$|^unset$|^none$|^null$",
    re.I,
)
_TAGGED = re.compile(r"^(?:AKIA|ASIA|gh[pousr]_|glpat-|xox[abeprs]-|[a-z]{2,4}_(?:live_|test_)?(?=\w*\d)|[a-z]{2}-(?=\w*\d\w*)(?=\w{16,}))[\w\-]{12,}$")
_UUID = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.I)
_HEX = re.compile(r"^[0-9a-f]{7,}$")
_WORD_NUMBER = re.compile(r"^[A-Za-z]+(?:[!#$*?+@][A-Za-z]+\d{2,4}|[._\-][A-Za-z]+\d{3,4})$")
_HOST = re.compile(r"^[\w-]+(?:\.[\w-]+)*\.(?:example|test|invalid|com|net|org|io|local|internal)$")
_ESCAPED = re.compile(r"\\([\"'])")
_CLASSES = (("up", re.compile(r"[A-Z]")), ("low", re.compile(r"[a-z]")), ("dig", re.compile(r"\d")), ("sp", re.compile(r"[!#$%^&*?~]")))


def _may_be_strong(low: str) -> bool:
    """False only where ``STRONG`` finds nothing; ``low`` is an ASCII text in lower case, as below."""
    return "key" in low or "token" in low or "pass" in low or "secret" in low or "pwd" in low or "credential" in low or "x-auth" in low or "authorization" in low


def _may_be_hash(low: str) -> bool:
    """False only where ``_HASH`` finds nothing."""
    return (
        "id" in low or "ha" in low or "tag" in low or "digest" in low or "checksum" in low or "md5" in low or "commit" in low or "revision" in low or "icon" in low
        or "image" in low or "base64" in low or "fingerprint" in low or "nonce" in low or "integrity" in low or "pattern" in low or "regex" in low
    )


def _may_stand_for_a_value(low: str) -> bool:
    """False only where ``_PLACEHOLDER`` finds nothing."""
    return (
        "change" in low or "example" in low or "replace" in low or "redacted" in low or "dummy" in low or "placeholder" in low or "your" in low or "xxxx" in low or "{" in low
        or "%" in low or "..." in low or "****" in low or low[:1] in ("<", "$") or low == "unset" or low == "none" or low == "null"
    )


@dataclass(slots=True)
class Token:
    text: str
    begin: int
    kind: str  # name, op, value, user, host, word, mark, pem
    quote: str
    inside: str = ""  # within a quoted text of several words: prose if it has words that only prose has, else plain
    opens: bool = False  # the first token of such a text


_IDENTIFIER = re.compile(r"[A-Za-z_]+\Z")
_DOTTED = re.compile(r"[A-Za-z](?=[A-Za-z_]*\.)[A-Za-z_.]*\Z")
_LETTERS = re.compile(r"[A-Za-z+/=]{9,}\Z")
_HOST_ENDS = (".example", ".test", ".invalid", ".com", ".net", ".org", ".io", ".local", ".internal")
_TURN = re.compile(r"[a-z][A-Z]")
_RUN_OF_CAPITALS = re.compile(r"[A-Z]{2}|[A-Z]$")


def _scrambled(text: str) -> bool:
    """Whether letters change case as no name does."""
    if text.islower() or not _LETTERS.match(text):
        return False
    upper = sum(map(str.isupper, text))
    mixed = 0.15 * len(text) <= upper <= 0.8 * len(text) and _TURN.search(text)
    return bool(mixed and (upper >= 0.3 * len(text) or _RUN_OF_CAPITALS.search(text)))


def shape(text: str) -> str:
    """The coarse shape of a token's text; a quote that is escaped in it is a quote."""
    if len(text) < 7 and text.isdigit() and text.isascii():  # what the rules below come to for few digits
        return "number"
    if "\\" in text:
        text = _ESCAPED.sub(r"\1", text)
    if (not text.isascii() or _may_stand_for_a_value(text.lower())) and _PLACEHOLDER.search(text):
        return "placeholder"
    if _IDENTIFIER.match(text) and not text.startswith(("AKIA", "ASIA", "gh")):  # what the rules below come to for letters
        return "letters" if _scrambled(text) else "word"
    if _DOTTED.match(text) and not text.startswith("eyJ"):  # the same for letters with dots
        return "host" if text.endswith(_HOST_ENDS) and _HOST.match(text) else "word"
    if len(text) == 36 and _UUID.match(text):
        return "uuid"
    if _HEX.match(text) and any(c.isdigit() for c in text):
        return "hex40" if len(text) >= 32 else "hex"
    if text.startswith("eyJ") and "." in text:
        return "jwt"
    if _TAGGED.match(text):
        return "tagged"
    if "[" in text and "]" in text or "\\" in text:
        return "pattern"
    if text.endswith(_HOST_ENDS) and _HOST.match(text):
        return "host"
    if _WORD_NUMBER.match(text):
        return "wordnum"
    if re.match(r"^[a-z]+(?:-[a-z]+){3,}\d{0,4}!?$", text):
        return "phrase"
    if re.match(r"^[A-Za-z]+(?:-[A-Za-z]+)+$", text):
        return "dashed"
    if re.match(r"^\d[\d.,:_/x\-]*$", text):
        return "number"
    if re.match(r"^\$?[A-Za-z_][A-Za-z_.\-]*\d{1,3}$", text) and len(text) < 40 and not re.search(r"[a-z][A-Z][a-z]*[A-Z][A-Z]", text):
        return "indexed"
    kinds = {k for k, rule in _CLASSES if rule.search(text)}
    if "dig" in kinds and kinds & {"up", "low"}:
        special = "sp" in kinds or bool(re.search(r"[+/]", text))
        switches = sum(a.isdigit() != b.isdigit() for a, b in zip(text, text[1:]))
        return ("leet" if "up" not in kinds else "mixed") + ("+" if special else "") + ("" if switches > 2 else "-few")
    if "sp" in kinds and kinds & {"up", "low"} and len(text) > 5:
        return "special"
    if _scrambled(text):
        return "letters"
    if not kinds:
        return "punct"
    return "word"


def _split(text: str, begin: int, quote: str, out: list[Token]) -> None:
    """A run of characters as tokens: parts of a URL, a name with its value, or one token."""
    todo: list[Token | tuple[int, int]] = [(0, len(text))]
    while todo:
        part = todo.pop()
        if isinstance(part, Token):
            out.append(part)
            continue
        at, end = part
        url = "://" in text and _URL.match(text, at, end)
        if url:
            out.append(Token(url.group(), begin + at, "op", quote))
            at = url.end()
            user = _USER.match(text, at, end)
            if user:
                out.append(Token(user.group(1), begin + at, "user", quote))
                out.append(Token(":", begin + user.end(1), "op", quote))
                out.append(Token(user.group(2), begin + user.start(2), "pass", quote))
                at = user.end() - 1
                out.append(Token("@", begin + at, "op", quote))
                at += 1
            tail = _QUERY.search(text, at, end)
            stop = tail.start() if tail else end
            if stop > at:
                out.append(Token(text[at:stop], begin + at, "host", quote))
            rest: list[Token | tuple[int, int]] = []
            while stop < end:
                more = _QUERY.search(text, stop + 1, end)
                rest += [Token(text[stop], begin + stop, "op", quote), (stop + 1, more.start() if more else end)]
                stop = more.start() if more else end
            todo += reversed(rest)
            continue
        named = _ASSIGN.match(text, at, end)
        if named and (not quote or _QUOTED_ASSIGN.match(text, at, end)):
            out.append(Token(named.group(1), begin + at, "name", quote))
            out.append(Token(named.group(2), begin + named.start(2), "op", quote))
            todo.append((named.end(), end))
            continue
        word = text[at:end]
        bare = "" if quote else word.rstrip(".:")
        if bare and bare != word:
            todo += [Token(word[len(bare) :], begin + at + len(bare), "op", ""), (at, at + len(bare))]
        elif word:
            plain = any(c.isalnum() for c in word)
            out.append(Token(word, begin + at, "value" if quote else "word" if plain else "mark", quote))


def lex(line: str) -> list[Token]:
    out: list[Token] = []
    for m in _LEX.finditer(line):
        _add_piece(m.group(), m.start(), m.lastgroup or "run", out)
    return out


def _add_piece(piece: str, begin: int, kind: str, out: list[Token]) -> None:
    if kind == "run":
        _split(piece, begin, "", out)
    elif kind == "quoted":
        mark, text = piece[0], piece[1:-1]
        out.append(Token(mark, begin, "mark", ""))
        if any(map(str.isspace, text)):
            inner = lex(text)
            prose = any(t.text.lower() in _GLUE for t in inner)
            for n, t in enumerate(inner):
                t.begin += begin + 1
                t.inside, t.opens = t.inside or ("prose" if prose else "plain"), n == 0
            out += inner
        else:
            _split(text, begin + 1, mark, out)
        out.append(Token(mark, begin + len(piece) - 1, "mark", ""))
    else:
        out.append(Token(piece, begin, "pem" if kind == "pem" else "mark", ""))


def _class(text: str) -> str:
    """What a word on the way to a value says about it."""
    low, ascii = text.lower(), text.isascii()
    if ascii and text.isdigit():
        return "none"
    if (not ascii or _may_be_strong(low)) and STRONG.search(text) and not _TOLD.search(text):
        return "STRONG" if text.isupper() else "strong"
    if (not ascii or _may_be_hash(low)) and _HASH.search(text):
        return "hash"
    if low in ("basic", "bearer"):
        return low
    if low in _WEAK_WORDS or not ascii and _WEAK.match(text):
        return "weak"
    if text.rpartition(".")[2] in _READER:
        return "reader"
    if text.endswith(_HOST_ENDS) and _HOST.match(text):
        return "host"
    return "word" if text[:1].isalpha() else "none"


def described(t: Token) -> tuple:
    """All of a token that features look at, apart from its place."""
    if t.kind == "mark" or t.kind == "op":
        return t.text[:3], t.kind, t.opens
    form, length, here = _word(t.text) if len(t.text) <= _KEPT else _word.__wrapped__(t.text)
    if t.kind == "pem":
        form = "pem_" + ("private" if "PRIVATE" in t.text else "other") + ("_end" if "END" in t.text[:9] else "")
    return form, length, t.kind, bool(t.quote), here, t.inside, t.opens


@lru_cache(maxsize=20_000)
def _word(text: str) -> tuple[str, str, str]:
    """Shape, length and class of a token's text."""
    size = len(text)
    length = "0" if size < 6 else "6" if size < 9 else "9" if size < 16 else "16" if size < 28 else "28" if size < 50 else "50"
    return shape(text), length, _class(text)


def start(before: str) -> tuple:
    """What is known before the first token of a line: the context that the line above leaves open,
    the classes of the last words, what opens a quoted text, marks, where the last telling names of
    each class hold to, the last shape, whether a plus stood before, and which token comes."""
    return before, "none", "none", "none", "", -1, -1, -1, -1, "none", False, "first"


def follower(d: tuple | None) -> str:
    """What a token's features see of the next."""
    return "$" if d is None else d[0][:2] if len(d) == 3 else "word"


def step(state: tuple, d: tuple, following: str, at: int) -> tuple[tuple, tuple]:
    """All that the features of a token depend on, and the state after it. What a name says of the
    line holds for ``_REACH`` characters; ``at`` is where the token begins."""
    before, w1, w2, opener, marks, strong, hashed, reader, weak, last_shape, plus, first = state
    if d[-1]:
        opener = f"{w1}{marks}"
    if len(d) == 3:
        return d[:2], (before, w1, w2, opener, (marks + d[0])[-2:], strong, hashed, reader, weak, last_shape, plus or d[0] == "+", first)
    form, length, kind, quoted, here, inside, _ = d
    near = "strong" if strong >= at else "hash" if hashed >= at else "no"
    plain = form in ("word", "dashed", "indexed")
    context = (
        form, length, kind, quoted, w1, w2, marks, near, reader >= at, before, first, last_shape, plus,
        following, here if plain else form, weak >= at, inside, opener if inside else "",
    )
    w2 = w1
    if (plain or form in ("host", "placeholder")) and kind in ("word", "name", "value", "user", "host"):
        if here == "strong" or here == "STRONG":
            strong = at + _REACH
        elif here == "hash":
            hashed = at + _REACH
        elif here == "reader":
            reader = at + _REACH
        elif here == "weak":
            weak = at + _REACH
        w1 = here
    else:
        w1 = "lit"
    if kind == "host":
        w1 = "host"
    return context, (before, w1, w2, opener, "", strong, hashed, reader, weak, form, False, "later")


def contexts(described_tokens: list[tuple], before: str, begins: list[int]) -> Iterator[tuple]:
    """The context of each token; ``begins``: where the tokens begin."""
    state = start(before)
    for d, following, at in zip(described_tokens, [*described_tokens[1:], None], begins):
        context, state = step(state, d, follower(following), at)
        yield context


def spelled(context: tuple) -> list[str]:
    """The features of a token in its context."""
    if len(context) == 2:
        return [f"m={context[0]}", f"m|{context[1]}"]
    kind, length, k, q, w1, w2, marks, near, reader, before, first, last_shape, plus, nxt, self, weak, inside, opener = context
    upper = w1 == "STRONG"
    w1, w2, self = (("strong" if x == "STRONG" else x) for x in (w1, w2, self))
    out = [
        "bias", f"s={kind}", f"s={kind}|{length}", f"k={k}", f"q={q}", f"w1={w1}", f"w1={w1}|s={kind}", f"w1={w1}|{marks}|s={kind}",
        f"w2={w2}|w1={w1}|s={kind}", f"near={near}|s={kind}", f"near={near}|reader={reader}|s={kind}", f"k={k}|s={kind}", f"k={k}|w1={w1}|s={kind}",
        f"pre={before}|{first}|s={kind}", f"pre={before}|{first}|q={q}", f"last={last_shape}|plus={plus}|s={kind}", f"next={nxt}|s={kind}",
        f"self={self}", f"weak={weak}|s={kind}", f"weak={weak}|w1={w1}|{marks}|s={kind}", f"k={k}|near={near}|s={kind}|{length}",
    ]
    if inside:
        out += [f"in={inside}", f"in={inside}|{opener}", f"in={inside}|{opener}|s={kind}", f"in={inside}|near={near}|s={kind}"]
    if upper:
        out += [f"up|{marks}|s={kind}|q={q}", f"up|{marks}|s={kind}|q={q}|{nxt}"]
    return out


@dataclass
class Line:
    """A line with its tokens and what the lines above leave open."""

    number: int
    offset: int
    tokens: list[Token]
    before: str

    @property
    def contexts(self) -> Iterator[tuple]:
        return contexts([described(t) for t in self.tokens], self.before, [t.begin for t in self.tokens])

    @property
    def features(self) -> list[list[str]]:
        return [spelled(c) for c in self.contexts]


_NAMES = re.compile(r"[A-Za-z_][\w.\-]*")
_LITERAL_END = re.compile(r"[\"'][A-Za-z0-9+/=]{30,}[\"']\s*[+,]?\s*$")


@lru_cache(maxsize=50_000)
def _tells(word: str) -> str:
    low, ascii = word.lower(), word.isascii()
    if (not ascii or _may_be_strong(low)) and STRONG.search(word):
        return "strong"
    return "hash" if (not ascii or _may_be_hash(low)) and _HASH.search(word) else ""


def left_open(line: str) -> str:
    """What a line leaves open for the next: the class of its last name, if it ends unfinished."""
    bare = line.rstrip()
    if not bare or bare[-1] not in _OPEN_LAST or not _OPEN_END.search(bare, max(0, len(bare) - 3)):
        return "closed"
    for word in reversed(_NAMES.findall(line)):
        tells = _tells(word) if len(word) <= _KEPT else _tells.__wrapped__(word)
        if tells:
            return tells
    return "literal" if _LITERAL_END.search(line) else "open"


def all_lines(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(number, offset, line, what is left open above) of every line of ``text``, split at LF, that
    is not blank."""
    offset, before = 0, "closed"
    for n, line in enumerate(text.split("\n")):
        bare = line.rstrip()
        if bare:
            yield n + 1, offset, line, before
            before = left_open(line) if bare[-1] in _OPEN_LAST else "closed"
        offset += len(line) + 1


def read_lines(text: str) -> Iterable[Line]:
    return (Line(n, offset, lex(line), before) for n, offset, line, before in all_lines(text))


class Forms(dict):
    """Pieces of lines to a number for what the features see of them; pieces that look the same to
    every feature share one. Beyond ``_PIECES_KEPT`` pieces, they are worked out anew."""

    def __init__(self) -> None:
        super().__init__()
        self.kinds: dict[tuple, int] = {}  # what features see of one token, to a number
        self.seen: list[list[int]] = []
        self.known: dict[tuple, int] = {}

    @staticmethod
    def _looks(piece: str) -> tuple[tuple, ...]:
        if piece[0] not in _QUOTES and "=" not in piece and ":" not in piece and piece[-1] != ".":  # one token
            if piece[0] in _MARKS:
                return ((piece, "mark", False),)
            if piece[:5] != "-----":
                if not piece[0].isalnum() and not any(map(str.isalnum, piece)):
                    return ((piece[:3], "mark", False),)
                form, length, here = _word.__wrapped__(piece)  # pieces are kept here
                return ((form, length, "word", False, here, "", False),)
        return tuple(described(t) for t in lex(piece))

    def __missing__(self, piece: str) -> int:
        looks = self._looks(piece)
        number = self.known.get(looks)
        if number is None:
            number = self.known[looks] = len(self.seen)
            self.seen.append([self.kinds.setdefault(d, len(self.kinds)) for d in looks])
        if len(piece) <= _KEPT and len(self) < _PIECES_KEPT:
            self[piece] = number
        return number

    def of(self, line: str) -> tuple[int, ...]:
        return tuple(map(self.__getitem__, _PIECES.findall(line)))

    def tokens(self, numbers: tuple[int, ...]) -> list[int]:
        """The numbers, in ``kinds``, of the tokens of pieces."""
        return [d for k in numbers for d in self.seen[k]]
