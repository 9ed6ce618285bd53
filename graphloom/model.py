"""Schemas, edge metadata and fixed values of the property graph."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, k != "uid") for k, v in columns.items()])


SYMBOL = _schema(uid=_S, name=_S, kind=_S, repo_uid=_S, file_path=_S, start_line=_L, end_line=_L, signature=_S, is_entry_point=_B, visibility=_S)
NOTE = _schema(uid=_S, vault_uid=_S, file_path=_S, title=_S, note_kind=_S, word_count=_L, created_at=_S, modified_at=_S)
SECTION = _schema(uid=_S, note_uid=_S, start_line=_L, end_line=_L, text_content=_S, word_count=_L)
EDGE = T.StructType([T.StructField("src", _S, False), T.StructField("dst", _S, False), T.StructField("rel", _S, False), T.StructField("confidence", _D), T.StructField("evidence", _S)])
CONTRACT = _schema(uid=_S, kind=_S, verb=_S, path=_S, operation_id=_S, repo_uid=_S, source_path=_S, confidence=_D)

# Relation names and their weights in ranking.
CODE_RELATIONS = ("CALLS", "USES", "ACCESSES", "IMPORTS", "EXTENDS_SYM", "IMPLEMENTS_SYM", "INCLUDES_SYM", "MEMBER_OF")
IMPACT_RELATIONS = ("CALLS", "IMPORTS", "EXTENDS_SYM", "IMPLEMENTS_SYM", "INCLUDES_SYM", "CROSS_REPO_LINK")
DATA_RELATIONS = ("USES", "ACCESSES")
PROCESS_RELATIONS = ("CALLS", "IMPORTS", "CROSS_REPO_LINK")
NOTE_RELATIONS = ("NOTE_HAS_HEADING", "NOTE_HAS_SECTION", "HEADING_HAS_SECTION", "HEADING_PARENT", "WIKILINK_TO_NOTE", "WIKILINK_TO_HEADING", "SUPERSEDES", "DEPENDS_ON", "CAUSED_BY", "RELATES_TO", "NOTE_TAGGED_WITH", "SECTION_TAGGED_WITH")
BRIDGE_RELATIONS = ("REFERENCES_CODE_NOTE_TO_SYMBOL", "REFERENCES_CODE_SECTION_TO_SYMBOL")
PROJECT_RELATIONS = ("PROJECT_INCLUDES_NOTE", "PROJECT_INCLUDES_SYMBOL", "PROJECT_INCLUDES_REPO", "PROJECT_HAS_COMPONENT", "PROJECT_HAS_PARENT")
RELATION_WEIGHT = {"CALLS": 1.0, "EXTENDS_SYM": 0.9, "IMPLEMENTS_SYM": 0.9, "IMPORTS": 0.7, "USES": 0.5, "ACCESSES": 0.4, "MEMBER_OF": 0.2, "INCLUDES_SYM": 0.2}
REVERSE_WEIGHT = 0.3
SCOPES = {"code": CODE_RELATIONS, "notes": NOTE_RELATIONS, "unified": CODE_RELATIONS + NOTE_RELATIONS + BRIDGE_RELATIONS + PROJECT_RELATIONS}
CALLABLE_KINDS = ("Function", "Method")
TYPE_KINDS = ("Interface", "TypeAlias", "Enum", "Module")

# What a query is for, and how far a walk then spreads.
DAMPING = {"find-definition": 0.5, "understand-architecture": 0.85, "analyze-impact": 0.7, "general-context": 0.75, "project-context": 0.7}
CALLS_MULTIPLIER = {"analyze-impact": 2.0}
PROJECT_MULTIPLIER = {"project-context": 5.0}
PPR_FLOOR = 1e-4

# Files by extension.
LANGUAGE_OF = {
    "javascript": "js jsx mjs cjs", "typescript": "ts tsx mts cts", "java": "java", "go": "go", "python": "py", "cpp": "cpp cc cxx hpp h", "rust": "rs", "kotlin": "kt kts", "csharp": "cs", "php": "php", "ruby": "rb rake", "swift": "swift", "c": "c", "dart": "dart",
    "cobol": "cbl cob cpy", "lua": "lua", "bash": "sh bash", "scala": "scala sc", "elixir": "ex exs", "zig": "zig", "objc": "m mm", "groovy": "groovy gradle", "powershell": "ps1 psm1", "julia": "jl", "sql": "sql", "hcl": "tf hcl", "fortran": "f90 f95 f03 f08",
    "pascal": "pas pp", "vue": "vue", "svelte": "svelte", "astro": "astro", "systemverilog": "sv svh",
}
BUILD_FILES = "Makefile GNUmakefile makefile Dockerfile Containerfile Jenkinsfile Justfile justfile build.rs build.gradle.kts settings.gradle.kts CMakeLists.txt go.mod go.sum Gemfile Rakefile setup.py conftest.py Package.swift mix.exs meson.build SConstruct SConscript".split()
BUILD_EXTENSIONS = "json jsonc toml yaml yml xml lock ini cfg conf mk cmake gradle tf hcl sh bash ps1 psm1".split()
BUILD_FOLDERS = ".github .circleci generated __generated__".split()

# How sure a reference is by how it was matched, and what a language takes off or adds.
MATCH_BASE = {"SameFileExact": 0.95, "ImportResolved": 0.90, "ReExportResolved": 0.75, "SamePackageFallback": 0.50, "Unresolved": 0.0}
MATCH_MODIFIER = {
    "ImportResolved": {0.05: "java go cpp rust kotlin csharp scala", 0.03: "dart swift", -0.05: "elixir php", -0.10: "lua python ruby", -0.15: "bash cobol"},
    "ReExportResolved": {-0.05: "javascript typescript vue svelte astro"},
    "SamePackageFallback": {-0.15: "python ruby"},
}
ENTRY_NAMES = "main handler handle run start execute serve init".split()
PATH_DEBOOST = (("/playwright/", None, 0.2), ("/__tests__/", None, 0.3), ("/cypress/", None, 0.3), ("/e2e/", None, 0.3), ("/tests/", None, 0.3), ("/test/", None, 0.3), (None, ".test.ts", 0.3), (None, ".spec.ts", 0.3))
KIND_PRIORITY = ("Class", "Interface", "Function", "Method")
MENTION_BASE = {"Function": 0.9, "Method": 0.7, "Module": 0.7, "Constant": 0.6, "Property": 0.6, "Variable": 0.6}
UID_KINDS = {"repo": "Repo", "file": "File", "svc": "Service", "sym": "Symbol", "vlt": "Vault", "note": "Note", "head": "Heading", "sec": "Section", "tag": "Tag", "proj": "Project", "contract": "Contract"}
STOPWORDS = "the and for that with this from are was not but you all can has have will its our one out use".split()
