"""What a file's path says about it, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by extension, and by name where there is none.
LANGUAGES = {
    "py": "python", "pyi": "python", "java": "java", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript",
    "tsx": "typescript", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "c_sharp",
    "kt": "kotlin", "kts": "kotlin", "swift": "swift", "scala": "scala", "sh": "shell", "md": "markdown", "yaml": "yaml", "yml": "yaml", "json": "json",
    "toml": "toml", "xml": "xml", "sql": "sql", "properties": "properties", "dockerfile": "dockerfile",
}
NAMED_LANGUAGES = {"dockerfile": "dockerfile", "makefile": "make", "rakefile": "ruby", "gemfile": "ruby"}
#: Extensions by content axis.
DOCS_EXTENSIONS = (".md", ".markdown", ".rst", ".txt", ".adoc")
CONFIG_EXTENSIONS = (".properties", ".yml", ".yaml", ".toml", ".json", ".xml", ".sql", ".conf", ".cfg", ".ini", ".env", ".gradle")
CODE_EXTENSIONS = (
    ".c", ".cc", ".cpp", ".cs", ".go", ".h", ".hpp", ".java", ".js", ".jsx", ".kt", ".kts", ".m", ".mm", ".php", ".py", ".rb", ".rs", ".scala", ".swift", ".ts", ".tsx"
)
#: Roots and names of tests.
TEST_ROOTS_ALWAYS = ("__test__", "__tests__", "androidTest", "jvmTest", "integrationTest")
TEST_ROOTS = ("test", "tests", "spec", "specs")
MAIN_SEGMENTS = ("main", "production")
TEST_NAMES = r"^(?:test_|spec_)|(?:_test|_spec|_tests|_specs)$"
TEST_INFIXES = r"\.(?:test|spec)\."
CLASS_EXTENSIONS = ("java", "kt", "swift")
TEST_CLASSES = r"(?:Test|Tests|TestCase)$"
#: Roots and names of code that is not canonical.
SIDE_ROOTS = ("compat", "example", "examples", "fakes", "gen", "generated", "legacy", "mock", "mocks", "stubs", "third_party", "vendor")
SOURCE_SEGMENTS = ("app", "com", "dev", "io", "java", "kotlin", "main", "net", "org", "production", "src", "test", "tests")
SIDE_NAMES = r"^(?:fake_|generated_|legacy_|mock_|stub_)|(?:_example|_fake|_gen|_generated|_legacy|_mock|_stub)$"
SIDE_INFIXES = r"\.(?:example|fake|gen|generated|mock|stub)\."
SIDE_CLASSES = r"(?:Fake|Generated|Legacy|Mock|Stub)$"
BARRELS = ("__init__.py", "package-info.java", "index.ts", "index.js")
#: Words and names of file roles.
ANALYSIS_SEGMENTS = ("reports", "analysis", "benchmarks")
INFRA_PREFIXES = r"^(?:docker|k8s|compose)"
INFRA_TAILS = r"(?:dockerfile|makefile)$"
INFRA_SEGMENTS = ("deploy", "deployment", "infra", "infrastructure", "k8s", "kubernetes")
INFRA_NAMES = ("package-lock.json", "pom.xml", "maven-wrapper.properties", "docker-compose.yml")
ROLE_WORDS = (
    ("model", ("model", "entity", "entities", "models")), ("dto", ("dto", "dtos", "vo", "viewmodel", "request", "response")),
    ("assembler", ("assembler", "assemblers", "mapper", "mappers", "converter")), ("exception", ("exception", "exceptions", "error", "errors")),
)
ROLE_CONFIG = (".xml", ".sql", ".properties", ".gradle", ".yml", ".yaml", ".json", ".toml")
#: Segments and names of documentation and configuration tiers.
DOC_THIRD_PARTY = ("fitnesseroot", "vendor", "vendors", "node_modules", "third_party", "third-party", "thirdparty", "samples", "sample", "examples")
DOC_GENERATED_NAMES = ("help.md", "changelog.md")
DOC_GENERATED = ("generated", "target", "build", "dist")
DOC_ROOT_NAMES = ("readme.md", "readme.rst", "readme.txt")
CONFIG_GENERATED = ("target", "build", "dist", "out")
CONFIG_SAMPLES = ("sample", "samples", "example", "examples", "demo")


def parts(path: Column) -> Column:
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def suffix(path: Column) -> Column:
    """The extension with its dot, in lower case; empty for names without one or that begin with it."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"^(.+)\.[^.]+$", "$1")


def _in(column: Column, values) -> Column:
    return column.isin(*values)


def _has(path: Column, values) -> Column:
    return F.arrays_overlap(path, F.array(*[F.lit(v) for v in values]))


def language(path: Column) -> Column:
    """The language by extension, else by name; null where neither is known."""
    by = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    named = F.create_map(*[F.lit(x) for kv in NAMED_LANGUAGES.items() for x in kv])
    return F.coalesce(by[F.substring(suffix(path), 2, 20)], named[F.lower(basename(path))])


def content_axis(path: Column) -> Column:
    name = F.lower(basename(path))
    return (
        F.when(_in(suffix(path), DOCS_EXTENSIONS), "docs")
        .when(_in(suffix(path), CONFIG_EXTENSIONS) | name.startswith(".env") | (name == "environment"), "config").otherwise("code")
    )


def _rooted(path: Column, roots, blockers, extra) -> Column:
    """Whether a segment is one of ``roots`` with none of ``blockers`` before it, or ``extra`` says so."""
    p = parts(path)
    return F.exists(
        F.sequence(F.lit(0), F.size(p) - 1),
        lambda i: extra(p, i) | (_in(F.get(p, i), roots) & ~_has(F.slice(p, 1, i), blockers)),
    )


def is_test(path: Column) -> Column:
    by_class = _in(F.substring(suffix(path), 2, 9), CLASS_EXTENSIONS) & stem(path).rlike(TEST_CLASSES)
    by_name = F.lower(stem(path)).rlike(TEST_NAMES) | F.lower(basename(path)).rlike(TEST_INFIXES) | by_class
    extra = lambda p, i: _in(F.get(p, i), TEST_ROOTS_ALWAYS) | ((F.get(p, i) == "test") & (i > 0) & (F.coalesce(F.get(p, i - 1), F.lit("")) == "src"))
    return by_name | _rooted(path, TEST_ROOTS, MAIN_SEGMENTS, extra)


def is_non_canonical(path: Column) -> Column:
    by_class = _in(F.substring(suffix(path), 2, 9), CLASS_EXTENSIONS) & stem(path).rlike(SIDE_CLASSES)
    by_name = F.lower(stem(path)).rlike(SIDE_NAMES) | F.lower(basename(path)).rlike(SIDE_INFIXES) | by_class
    return by_name | _rooted(path, SIDE_ROOTS, SOURCE_SEGMENTS, lambda p, i: F.lit(False))


def path_class(path: Column, definitions: Column) -> Column:
    """TEST > NON_CANONICAL > DTS > BARREL > CANONICAL; ``definitions`` counts a file's definition chunks."""
    return (
        F.when(is_test(path), "test").when(is_non_canonical(path), "non_canonical").when(F.lower(basename(path)).endswith(".d.ts"), "dts")
        .when(_in(basename(path), BARRELS) & (F.coalesce(definitions, F.lit(0)) == 0), "barrel").otherwise("canonical")
    )


def file_role(path: Column) -> Column:
    p, name, ext = parts(path), F.lower(basename(path)), suffix(path)
    words = F.flatten(F.transform(F.concat(F.array(F.lower(stem(path))), p), lambda x: F.split(x, r"[._\-]+")))
    out = (
        F.when(_has(p, ANALYSIS_SEGMENTS), "analysis").when(content_axis(path) == "docs", "docs")
        .when(name.rlike(INFRA_PREFIXES) | F.lower(stem(path)).rlike(INFRA_TAILS) | (ext == ".sh"), "infra")
        .when(~_in(ext, CODE_EXTENSIONS) & _has(p, INFRA_SEGMENTS), "infra").when(_in(name, INFRA_NAMES), "infra")
    )
    for role, vocabulary in ROLE_WORDS:
        out = out.when(_has(words, vocabulary), role)
    return out.when(_in(ext, ROLE_CONFIG), "config").otherwise("code")


def doc_tier(path: Column) -> Column:
    p, name = F.transform(parts(path), F.lower), F.lower(basename(path))
    return (
        F.when(_has(p, DOC_THIRD_PARTY), "third_party").when(_in(name, DOC_GENERATED_NAMES) | _has(p, DOC_GENERATED), "generated")
        .when(_has(p, ("src",)), "nested").when(_in(name, DOC_ROOT_NAMES) | _has(p, ("docs", "doc")), "project").otherwise("other")
    )


def config_tier(path: Column) -> Column:
    p, name = F.transform(parts(path), F.lower), F.lower(basename(path))
    main = name.rlike("^(?:application|bootstrap)")
    return (
        F.when(_has(p, CONFIG_GENERATED), "generated").when(F.lower(path).contains("test/resources"), "test").when(_has(p, CONFIG_SAMPLES), "sample")
        .when(main, "primary").when(F.lower(path).contains("/src/main/resources/") & F.lower(path).contains("/config/"), "primary").otherwise("other")
    )


def package_segments(path: Column) -> Column:
    """Directories after the last source root; all directories where there is none."""
    folders = F.slice(parts(path), 1, F.greatest(F.size(parts(path)) - 1, F.lit(0)))
    marks = F.transform(folders, lambda x, i: F.when(_in(x, ("src", "source", "java", "kotlin", "scala", "groovy")), i + 1).otherwise(0))
    last = F.coalesce(F.array_max(marks), F.lit(0))
    return F.array_distinct(F.filter(F.slice(folders, last + 1, F.size(folders)), lambda x: x != ""))


def package_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the package segments of two paths; two empty ones are alike."""
    x, y = package_segments(a), package_segments(b)
    both = F.size(F.array_union(x, y))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / both)
