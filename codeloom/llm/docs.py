"""Functions paired with their documentation (problem 2), by parsing expression grammars."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.peg import Grammar, Node
from codeloom.operators.common import keep_latest

KINDS = ("function", "method", "constructor")

_PYTHON = r"""
source    <- unit? (leap / later / skip)*
leap      <- ~"(?:(?![ \t]*(?:#|@|async\b|def\b)|[^\n]*(?:\"\"\"|'''))[^\n]*(?:\n|\Z))+"
skip      <- ~"[^\n\"'#]*" (triple / ~"[^\n]*(?:\n|\Z)")
triple    <- ~"\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"" / ~"'''(?:[^'\\]|\\.|'(?!''))*'''"
unit      <- lead* decl doc?
later     <- lead* decl doc?
lead      <- blank / line / marker
blank     <- ~"[ \t]*\r?\n"
line      <- ~"[ \t]*#[^\n]*(?:\n|\Z)"
marker    <- ~"[ \t]*@[^\n]*(?:\n|\Z)"
decl      <- ~"[ \t]*(?:async[ \t]+)?def[ \t]+" name ~"\s*(?:\[[^\]\n]*\])?" params ~"[ \t]*(?:->[^\n]*?)?:[ \t]*(?:#[^\n]*)?(?:\r?\n|(?=[^\n])|\Z)"
name      <- ~"[^\W\d]\w*"
params    <- '(' (params / string / ~"[^()\"'#]+" / ~"#[^\n]*")* ')'
doc       <- (blank / line)* ~"[ \t]*" string
string    <- ~"[rRuU]?\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"" / ~"[rRuU]?'''(?:[^'\\]|\\.|'(?!''))*'''" / ~"[rRuU]?\"(?:[^\"\\\n]|\\.)*\"" / ~"[rRuU]?'(?:[^'\\\n]|\\.)*'"
"""

#: What the languages with braces share: the first unit may be cut off, later ones are read with
#: their parameters up to the body, as calls look like them.
_BRACES = r"""
source    <- unit? (leap / later / block / skip)*
leap      <- ~"(?:(?![ \t]*(?:/\*|//|@|#\[)|[^\n(]*=>)[^\n(]*(?:\n|\Z))+"
skip      <- ~"[^\n]*(?:\n|\Z)"
unit      <- lead* decl
later     <- lead* strict
"""
_SLASH_LEADS = r"""
lead      <- blank / block / line / marker
blank     <- ~"[ \t]*\r?\n"
block     <- ~"[ \t]*/\*.*?\*/[ \t]*(?:\r?\n)?"
line      <- ~"[ \t]*//[^\n]*(?:\n|\Z)"
marker    <- ~"[ \t]*@(?!interface\b)[\w.$]+[ \t]*" args? ~"[ \t]*(?:\r?\n)?" / ~"[ \t]*#\[[^\n]*\][ \t]*(?:\r?\n)?"
args      <- '(' (args / quoted / ~"[^()\"']+")* ')'
quoted    <- ~"\"(?:[^\"\\\n]|\\.)*\"" / ~"'(?:[^'\\\n]|\\.)*'"
"""

_JAVA = (
    _BRACES
    + r"""
decl      <- ~"[ \t]*" modifiers !other ~"(?:<[^<>]*>\s*)?" (name &open / type ~"[\s*&]+" name &open)
strict    <- ~"[ \t]*" modifiers !other ~"(?:<[^<>]*>\s*)?" (type ~"[\s*&]+" name ~"\s*" args ends / name args ~"\s*(?:throws\s[^{;=()]*)?\{")
ends      <- ~"\s*(?:(?:throws\s|where\s|const\b|noexcept\b|override\b)[^{;=()]*)*[{;]"
modifiers <- ~"(?:(?:public|protected|private|internal|static|final|abstract|synchronized|native|default|strictfp|virtual|override|sealed|async|extern|inline|constexpr|explicit|unsafe|const|unsigned)\s+)*"
other     <- ~"(?:class|interface|enum|record|struct|namespace|using|return|new|if|for|while|switch|throw|else|import|package|var|catch|delete|case|do|try)\b"
type      <- ~"[\w.$:]+(?:\s*<[^()]*?>)?(?:\s*\[\s*\])*(?=[\s*&]+[\w$:~]+\s*\()"
name      <- ~"[^\W\d][\w$]*(?:::~?\w+)*"
open      <- ~"\s*\("
"""
    + _SLASH_LEADS
)

_SCRIPT = (
    _BRACES
    + r"""
decl      <- ~"[ \t]*" modifiers (function / value / method)
strict    <- ~"[ \t]*" modifiers (function / value / method_all)
modifiers <- ~"(?:(?:export|default|declare|public|protected|private|static|readonly|abstract|override|async)\s+)*"
function  <- ~"function\s*\*?\s*" name ~"\s*[<(]"
value     <- ~"(?:const|let|var)\s+" name ~"\s*(?::[^=\n]*)?=\s*(?:async\s*)?(?:function\b|\(|[\w$]+\s*=>)"
method    <- !other ~"(?:(?:get|set)\s+)?\*?\s*" name ~"\s*(?:<[^()\n]*>)?\("
method_all <- !other ~"(?:(?:get|set)\s+)?\*?\s*" name ~"\s*(?:<[^()\n]*>)?" args ~"\s*(?::[^{}=;\n]*)?\{"
other     <- ~"(?:class|interface|enum|type|namespace|return|new|if|for|while|switch|throw|else|import|await|do|case|typeof|catch|with|super)\b"
name      <- ~"#?[^\W\d][\w$]*"
"""
    + _SLASH_LEADS
)


def _keyed(before: str, after: str) -> str:
    """A grammar of a language whose declarations have a keyword."""
    return _BRACES + f"""
decl      <- ~"[ \\t]*{before}" name ~"{after}"
strict    <- decl
name      <- ~"[^\\W\\d]\\w*[!?]?"
""" + _SLASH_LEADS


_RUBY = r"""
source    <- unit? (leap / later / skip)*
leap      <- ~"(?:(?![ \t]*(?:#|def\b|private\b|public\b|protected\b))[^\n]*(?:\n|\Z))+"
skip      <- ~"[^\n]*(?:\n|\Z)"
unit      <- lead* decl
later     <- lead* decl
lead      <- blank / line
blank     <- ~"[ \t]*\r?\n"
line      <- ~"[ \t]*#[^\n]*(?:\n|\Z)"
decl      <- ~"[ \t]*(?:(?:private|public|protected)[ \t]+)?def[ \t]+(?:self\.)?" name
name      <- ~"[^\W\d]\w*[!?=]?"
"""

_TEXTS = {
    "python": _PYTHON, "java": _JAVA, "csharp": _JAVA, "cpp": _JAVA, "c": _JAVA, "javascript": _SCRIPT, "typescript": _SCRIPT, "ruby": _RUBY,
    "go": _keyed(r"func\s*(?:\([^()]*\)\s*)?", r"\s*[\[(]"),
    "kotlin": _keyed(r"(?:(?:public|private|protected|internal|open|override|suspend|inline|abstract|final|operator|infix|tailrec)\s+)*fun\s+(?:<[^>\n]*>\s*)?(?:[\w<>?.]+\.)?", r"\s*\("),
    "rust": _keyed(r"(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|default|extern)\s+)*fn\s+", r"\s*[<(]"),
    "swift": _keyed(r"(?:(?:public|private|internal|fileprivate|open|static|class|override|mutating|final)\s+)*func\s+", r"\s*[<(]"),
    "scala": _keyed(r"(?:(?:private|protected|override|final|implicit|inline|abstract)(?:\[\w+\])?\s+)*def\s+", r"\s*[\[(:=]"),
    "php": _keyed(r"(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?\s*", r"\s*\("),
}
EXTENSIONS = {
    "py": "python", "java": "java", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "golang": "go", "kt": "kotlin", "kts": "kotlin",
    "rs": "rust", "swift": "swift", "scala": "scala", "php": "php", "rb": "ruby", "cs": "csharp", "c#": "csharp", "cpp": "cpp", "c++": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "h": "c", "c": "c",
}

#: Documentation that says nothing, in lower case and without marks.
PLACEHOLDERS = frozenset(
    [
        "todo", "todo document", "fixme", "xxx", "wip", "tbd", "na", "n a", "none", "undocumented", "description", "documentation",
        "add docs here", "add description", "add documentation here", "document me", "no description", "placeholder", "stub", "docstring",
        "auto generated method stub", "auto generated constructor stub", "auto generated", "generated", "nonjavadoc", "non javadoc",
        "noinspection", "missing docs", "to do", "to be done", "to be documented", "fill in", "lorem ipsum",
    ]
)
_TOOL = re.compile(
    r"^(?:eslint|tslint|jshint|jslint|prettier|istanbul|c8|v8 ignore|noqa|nolint|nosec|noinspection|pylint|flake8|mypy|pyright|type:\s*ignore|pragma|fmt:|isort|yapf|checkstyle|spotless|sonar|nosonar|@ts-|@formatter|go:|\+build|region\b|endregion\b|#region|#endregion|suppress)",
    re.I,
)
_LICENCE = re.compile(
    r"spdx-license|copyright\b|\(c\)\s*\d{4}|all rights reserved|licen[sc]ed under|permission is (?:hereby )?given|permission is hereby granted|warranty|terms kept in",
    re.I,
)
_CODE = re.compile(
    r"^(?:[\w.\[\]\"'$]+\s*(?::?=|\+=|-=|\*=)(?!=)\s*\S.*|(?:const|let|var|int|String|final|auto)\s+\w+\s*=.*|(?:return|throw|raise|await|yield)\b[^.]*[;()]\s*|(?:if|for|while|switch|with|try|elif|else)\b.*[{:]\s*|[\w.$]+\([^)]*\)\s*[;{]?|.*[;{}]\s*)$"
)
_REFERENCE = re.compile(
    r"^(?:\{?@?inherit-?doc\}?|\{@inheritdoc\}|@inheritdoc|(?:please )?(?:see|refer to|cf\.?|siehe|voir|v[ée]ase)\s+(?:the\s+)?(?:above|below|oben|unten|ci-dessus|arriba|@?link\b.*|\{@link[^}]*\}|[\w.#:/()-]+(?:\s+(?:class|interface|method|function|base class|superclass|parent|docs?|documentation))?)|same as (?:above|[\w.#]+(?:\(\))?)|@see\s+\S+)\s*[.]?$",
    re.I,
)
_TAG_LINE = re.compile(r"^(?:@|:|\\)(?P<tag>[A-Za-z]+)\b(?P<rest>.*)$")
#: Tags whose first word is the name of what they describe, not a description.
_NAMED_TAGS = frozenset(["param", "arg", "argument", "throws", "exception", "raises", "raise", "type", "keyword", "property", "template", "tparam"])
#: Words that a name may be dressed in without saying more.
_FILLERS = frozenset(
    "the a an this that function method constructor class procedure routine helper of for to and in on with is it its init new object instance".split()
)
_WORD = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[_\W]+")


def bare_documentation(text: str) -> list[str]:
    """The lines of a comment or docstring without its marks; tool remarks, licences, rules and
    disabled code are left out."""
    text = text.replace("\r\n", "\n").strip()
    for begin, end in (("/**", "*/"), ("/*", "*/"), ('"""', '"""'), ("'''", "'''")):
        if text.startswith(begin):
            text = text[len(begin) :].lstrip("*") if begin.startswith("/") else text[3:]
            text = text.removesuffix(end)
            break
    else:
        text = text.removesuffix("*/").removesuffix('"""').removesuffix("'''")
    out = []
    for line in text.split("\n"):
        bare = re.sub(r"^\s*(?:\*+(?!\*)|//+!?|#+(?!\w)|--)?\s?", "", line).strip()
        if not _WORD.search(bare) or _TOOL.match(bare) or _LICENCE.search(bare):
            continue
        if _CODE.match(bare) and not bare.endswith("."):
            continue
        out.append(bare)
    return out


def _subwords(name: str) -> set[str]:
    return {w.lower() for w in _CAMEL.split(name) if w}


def is_informative(lines: list[str], name: str, owner: str = "") -> bool:
    """Whether bare documentation says more than a placeholder, a reference, empty tags or the name.

    Tags with a text of their own count as documentation. For a constructor, ``owner`` is the
    class, whose name says as little as its own.
    """
    said = []
    for line in lines:
        tag = _TAG_LINE.match(line)
        if tag and not _REFERENCE.match(line):
            rest = tag["rest"].strip(" :-–.")
            if tag["tag"].lower() in _NAMED_TAGS:
                rest = re.sub(r"^(?:\{[^}]*\}\s*)?(?:<?\w+>?)?\s*[:\-–]*\s*", "", rest, count=1)
            if tag["tag"].lower() in ("see", "inheritdoc", "link", "since", "author", "version", "override", "internal", "private", "public", "deprecated") and not rest:
                continue
            if _WORD.search(rest) and tag["tag"].lower() not in ("see", "link", "author", "since", "version"):
                said.append(rest)
        elif not _REFERENCE.match(line.strip("() ")):
            said.append(re.sub(r"</?\w[^<>]*>", " ", line))
    words = [w.lower() for line in said for w in _WORD.findall(line)]
    if not words or " ".join(words) in PLACEHOLDERS:
        return False
    own = _subwords(name) | _subwords(owner) | _FILLERS | {name.lower(), name.strip("_").lower()}
    return any(w not in own and w.removesuffix("s") not in own for w in {x.lower() for line in said for x in re.findall(r"[^\W_]+", _CAMEL.sub(" ", line))})


@dataclass(frozen=True)
class Unit:
    """A function as its grammar's action emits it: the documentation is bare, offsets are the text's."""

    name: str
    declared: int
    lines: tuple[str, ...]
    doc_begin: int
    doc_end: int
    begin: int


def _emit(text: str, node: Node) -> Unit | None:
    """The action of ``unit`` and ``later``: the declaration's name with the comments that lead to it
    and the docstring that follows."""
    decl = node.find("decl", "strict")
    name = decl.find("name") if decl else None
    if decl is None or name is None:
        return None
    spans = [n for lead in node.parts("lead") for n in lead.children if n.rule in ("line", "block")]
    lines = [x for n in spans for x in bare_documentation(text[n.begin : n.end])]
    inner = node.parts("doc")
    string = inner[0].find("string") if inner else None
    if string is not None:
        spans.append(string)
        lines += bare_documentation(re.sub(r"^[rRuU](?=[\"'])", "", text[string.begin : string.end].strip()).strip("\"'"))
    begin = spans[0].begin if spans else decl.begin
    return Unit(text[name.begin : name.end], decl.begin, tuple(lines), begin, max((n.end for n in spans), default=decl.begin), node.begin)


GRAMMARS = {language: Grammar(text, {"unit": _emit, "later": _emit}) for language, text in _TEXTS.items()}


def parse_units(text: str, language: str) -> list[Unit]:
    """Every function that ``text`` declares, in order."""
    grammar = GRAMMARS.get(language)
    tree = grammar.parse(text) if grammar and text else None
    return [n.value for n in tree.children if n.value is not None] if tree else []


def parse_unit(text: str, language: str) -> tuple[str, int, list[str], int, int] | None:
    """(name, offset of the declaration, bare documentation, its begin and end offsets) of the
    function that ``text`` begins with, or None if it begins with something else."""
    units = parse_units(text, language)
    if not units or units[0].begin > 0:
        return None
    u = units[0]
    return u.name, u.declared, list(u.lines), u.doc_begin, u.doc_end


_UNIT_SCHEMA = "chunk long, updated_at timestamp, key string, own boolean, name string, documentation string, informative boolean, doc_begin int, doc_end int, code string"


def _language(language: str | None, path: str | None) -> str:
    if language and language.strip():
        low = language.strip().lower()
        return EXTENSIONS.get(low, low)
    return EXTENSIONS.get((path or "").rpartition(".")[2].lower(), "")


def _line_key(path: str | None, line: int | None, name: str | None) -> str:
    return f"l{path}\0{line}\0{name}"


def _units(with_code: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.bool_(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.string())
        for batch in batches:
            at, rows = [], []
            paths, langs, fqns = (batch.column(c).to_pylist() for c in ("file_path", "language", "fqn"))
            starts, texts = batch.column("line_start").to_pylist(), batch.column("content").to_pylist()
            for n, text in enumerate(texts):
                text = text or ""
                units = parse_units(text, _language(langs[n], paths[n]))
                first = units[0] if units and units[0].begin == 0 else None
                if fqns[n] is not None and first is None:
                    # a chunk of a symbol whose documentation may stand in the docstring
                    at.append(n)
                    rows.append((f"f{fqns[n]}", True, "", "", False, 0, 0, text if with_code else None))
                ends = [u.begin for u in units[1:]] + [len(text)]
                for u, end in zip(units, ends):
                    own = u is first
                    line = (starts[n] or 1) + text.count("\n", 0, u.declared)
                    key = f"f{fqns[n]}" if own and fqns[n] is not None else _line_key(paths[n], line, u.name)
                    at.append(n)
                    code = (text if own else text[u.begin : end]) if with_code else None
                    rows.append((key, own, u.name, "\n".join(u.lines), is_informative(list(u.lines), u.name, _owner(fqns[n])), u.doc_begin, u.doc_end, code))
            take = pa.array(at, pa.int64())
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk").take(take), batch.column("updated_at").take(take), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                names=["chunk", "updated_at", "key", "own", "name", "documentation", "informative", "doc_begin", "doc_end", "code"],
            )

    return run


def _owner(fqn: str | None) -> str:
    """The declaring type in ``path::Type.member(arguments)``; empty where there is none."""
    parts = (fqn or "").rpartition("::")[2].split("(")[0].split(".")
    return parts[-2] if len(parts) > 1 and parts[-1] in ("__init__", "constructor", parts[-2]) else ""


_SYMBOL_SCHEMA = "symbol long, updated_at timestamp, sfqn string, kind string, sfile string, sline int, sname string, stated string, stated_informative boolean"


def _symbol_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, fqns, docs = (batch.column(c).to_pylist() for c in ("sname", "sfqn", "docstring"))
        stated, good = [], []
        for name, fqn, doc in zip(names, fqns, docs, strict=True):
            lines = bare_documentation(doc) if doc else []
            stated.append("\n".join(lines))
            good.append(is_informative(lines, name or "", _owner(fqn)))
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("symbol", "updated_at", "sfqn", "kind", "sfile", "sline", "sname")], pa.array(stated, pa.string()), pa.array(good, pa.bool_())],
            names=["symbol", "updated_at", "sfqn", "kind", "sfile", "sline", "sname", "stated", "stated_informative"],
        )


def documented_functions(symbols: DataFrame, chunks: DataFrame, with_code: bool = True) -> DataFrame:
    """symbol, chunk, kind, name, own, documentation, doc_begin, doc_end, code for every documented function.

    Every function that a chunk declares is taken. A chunk is a symbol's own if it has its fqn, or,
    where its fqn is null, if the declaration that it begins with stands on the symbol's line under
    its name; a function further inside is met by file, line and name as well, and symbol is null
    where no symbol stands there. documentation is what the code says where that is informative,
    else what the symbol states; functions without either are left out. doc_begin and doc_end are
    offsets in the chunk's content (equal where the documentation stands in the symbol only). code
    (null unless ``with_code``) is the whole chunk for its own function, else the text from the
    function to the next. Of ids that come again the newest row holds. Null contents, names and
    docstrings say nothing.

    Every chunk is parsed once, and chunks and symbols meet in one join: a chunk's function has
    one key, its name or its place, and a symbol has both.
    """
    cols = ["id", "updated_at", "fqn", "file_path", "line_start", "language", "content"]
    code = chunks.where("content_type = 'code' and id is not null").select(*cols).withColumnRenamed("id", "chunk")
    units = code.select("chunk", F.col("updated_at").cast("timestamp").alias("updated_at"), *cols[2:]).mapInArrow(_units(with_code), _UNIT_SCHEMA)
    own = symbols.where(F.col("kind").isin(*KINDS) & F.col("id").isNotNull()).select(
        F.col("id").alias("symbol"), F.col("updated_at").cast("timestamp").alias("updated_at"), F.col("fqn").alias("sfqn"), "kind",
        F.col("file_path").alias("sfile"), F.col("line_start").alias("sline"), F.col("name").alias("sname"), "docstring",
    )
    named = own.mapInArrow(_symbol_docs, _SYMBOL_SCHEMA)
    units = keep_latest(units, chunks.select(F.col("id").alias("chunk"), F.col("updated_at").cast("timestamp").alias("updated_at")), "chunk")
    named = keep_latest(named, symbols.select(F.col("id").alias("symbol"), F.col("updated_at").cast("timestamp").alias("updated_at")), "symbol")
    place = F.concat(F.lit("l"), "sfile", F.lit("\0"), F.col("sline").cast("string"), F.lit("\0"), "sname")
    keys = F.array_compact(F.array(F.concat(F.lit("f"), "sfqn"), place))
    keyed = named.select("symbol", "kind", "stated", "stated_informative", F.explode(keys).alias("k"))
    both = units.join(keyed, F.col("key") == F.col("k"), "left").where("informative or (own and stated_informative)").where("symbol is not null or key like 'l%'")
    said = F.when(F.col("informative"), F.col("documentation")).otherwise(F.col("stated"))
    return both.select("symbol", "chunk", "kind", "name", "own", said.alias("documentation"), "doc_begin", "doc_end", "code")
