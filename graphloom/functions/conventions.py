"""Naming conventions of languages and frameworks, as tables of patterns.

A rule is (languages, result, name, path, signature, kinds); None matches anything; the first rule of a
symbol's language that matches tells. Patterns are searched, not anchored.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WEB = "javascript typescript vue svelte astro"
_DECLARED = "function class constant"
_NOT_HELPER = r"^(?!_|validate|parse|format)"

# How entry points are written, by language.
ENTRY_RULES = [
    (_WEB, "LambdaHandler", r"^handler$", r"(^|/)(lambda|handler)\.[jt]s$", None, None),
    (_WEB, "TestEntry", r"^(it|describe|test)$|^test_", None, None, None),
    (_WEB, "TestEntry", r"^[^_]", r"/__tests__/|\.(test|spec)\.[^/]*$", None, _DECLARED),
    (_WEB, "Main", None, r"\.config\.[^/]*$", None, _DECLARED),
    (_WEB, "HttpHandler", r"^[^_]", r"(^|/)middleware\.(ts|js|mjs|cjs)$", None, _DECLARED),
    (_WEB, "EventListener", r"^use\p{Lu}", r"/hooks/", None, "function"),
    (_WEB, "Main", r"^[^_]", r"/(stores|state)/", None, "function constant"),
    (_WEB, "EventListener", r"^[^_]", r"/(contexts|providers)/", None, _DECLARED),
    ("javascript typescript", "HttpHandler", _NOT_HELPER, r"/(pages|app|routes)/", None, _DECLARED),
    (_WEB, "HttpHandler", _NOT_HELPER, r"/(handlers|controllers)/", None, _DECLARED),
    (_WEB, "HttpHandler", r"Router$", None, r"router\(", None),
    (_WEB, "HttpHandler", None, None, r"app\.(get|post|put|delete|patch|use)\(|router\.(get|post|put|delete)\(", None),
    (_WEB, "HttpHandler", r"^(getServerSideProps|getStaticProps|getStaticPaths|loader|action)$", None, r"", None),
    (_WEB, "EventListener", r"^\p{Lu}", r"/components/", None, "function class"),
    (_WEB, "Main", r"^[^_]", r"(^|/)index\.[cm]?[jt]sx?$", None, _DECLARED),
    (_WEB, "Main", r"^[^_]", r"(^|/)(main|app)\.([jt]sx?|[cm][jt]s)$|(^|/)server\.([jt]s|[cm][jt]s)$", None, _DECLARED),
    (_WEB, "HttpHandler", r"^(handler|middleware)$", None, None, None),
    (_WEB, "Main", r"^(main|init|bootstrap|start|setup)$", None, None, None),
    ("python", "CliCommand", None, r"/management/commands/", None, None),
    ("python", "LambdaHandler", r"^(handler|lambda_handler)$", None, None, None),
    ("python", "TestEntry", r"^test_", None, None, None),
    ("python", "HttpHandler", None, r"(^|/)(views|routes|endpoints|handlers)\.py$", None, None),
    ("python", "Main", r"^main$", None, None, None),
    ("java", "Main", None, None, r"public static void main\(String", None),
    ("java", "HttpHandler", r"^do(Get|Post|Put|Delete)$", None, None, None),
    ("java", "HttpHandler", None, r"(Controller|Handler)\.java$", None, None),
    ("java", "TestEntry", r"^test", r"Tests?\.java$", None, None),
    ("go", "TestEntry", r"^(Test|Benchmark)", None, None, None),
    ("go", "HttpHandler", None, None, r"http\.ResponseWriter|\*http\.Request", None),
    ("go", "HttpHandler", r"^Handle$|Handler$", None, None, None),
    ("go", "Main", r"^main$", r"\.go$", None, None),
    ("go", "Main", r"^init$", None, None, None),
    ("c", "Main", None, None, r"(int|void) main\(", None),
    ("c", "Main", r"^(main|setup)$", None, None, None),
    ("c", "TestEntry", r"^test_", None, None, None),
    ("csharp", "Main", None, None, r"static (void|async Task) Main\(", None),
    ("csharp", "HttpHandler", None, r"Controller\.cs$", None, None),
    ("csharp", "TestEntry", r"^[Tt]est", r"Tests?\.cs$", None, None),
    ("kotlin dart swift rust cpp julia", "Main", r"^main$", None, None, None),
    ("kotlin", "TestEntry", r"^test", r"Test\.kt$", None, None),
    ("kotlin", "HttpHandler", None, None, r"@(Rest)?Controller", None),
    ("php", "HttpHandler", None, r"Controller\.php$|/routes/", None, None),
    ("php", "TestEntry", r"^test", r"Test\.php$", None, None),
    ("php", "CliCommand", r"^handle$", None, None, None),
    ("ruby", "HttpHandler", None, r"_controller\.rb$", None, None),
    ("ruby", "TestEntry", r"^(describe|it|context)$|^test_", None, None, None),
    ("ruby", "CliCommand", None, r"\.rake$", None, None),
    ("ruby", "EventListener", r"^(perform|call)$", None, None, None),
    ("dart", "TestEntry", r"^(test|testWidgets|group)$", None, None, None),
    ("dart", "TestEntry", None, r"_test\.dart$", None, None),
    ("swift", "Main", None, None, r"@main|didFinishLaunchingWithOptions", None),
    ("swift", "TestEntry", r"^test", r"Tests\.swift$", None, None),
    ("rust", "TestEntry", None, None, r"#\[(test\]|tokio::test|actix_web::test|async_std::test|rstest|test_case)", None),
    ("rust", "Main", None, None, r"#\[(tokio|actix_web)::main\]", None),
    ("julia", "TestEntry", r"^test_", None, None, None),
    ("fortran", "Main", r"(?i)^main$", None, None, "module"),
    ("pascal", "Main", r"(?i)^main$", None, None, None),
    ("cpp", "Main", None, None, r"int main\(", None),
    ("cpp", "TestEntry", r"^(TEST|TEST_F|TEST_P|TYPED_TEST|TEST_CASE)$", None, None, None),
]

# Marks that frameworks leave; the result is framework/role.
FRAMEWORK_RULES = [
    ("java kotlin", "spring/controller", None, None, r"@(Rest)?Controller", None),
    ("java kotlin", "spring/service", None, None, r"@Service", None),
    ("java kotlin", "spring/repository", None, None, r"@Repository", None),
    ("java kotlin", "spring/component", None, None, r"@Component", None),
    ("csharp", "aspnet/controller", None, None, r"\[ApiController\]", None),
    ("csharp", "aspnet/controller", None, r"Controller\.cs$", None, None),
    ("python", "django/view", None, r"(^|/)(views|viewsets)\.py$", None, "function method class"),
    ("python", "flask/handler", None, None, r"@app\.route|@router\.", None),
    ("javascript typescript", "nextjs/page", None, r"/(pages|app|routes)/", None, _DECLARED),
    ("javascript typescript", "express/handler", None, None, r"(app|router)\.(get|post|put|delete)\(", None),
    ("ruby", "rails/controller", None, r"_controller\.rb$", None, None),
    ("php", "laravel/controller", None, r"Controller\.php$", None, None),
    ("dart", "flutter/widget", None, None, r"extends (Stateless|Stateful)Widget", None),
    ("swift", "swiftui/view", None, None, r": View\b", None),
    ("go", "http/handler", None, None, r"http\.ResponseWriter|gin\.Context|echo\.Context", None),
]


def _first(rules: list[tuple], language: Column, name: Column, path: Column, signature: Column, kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for languages, result, n, p, s, kinds in reversed(rules):
        hit = language.isin(*languages.split())
        for column, pattern in ((name, n), (path, p)):
            hit = hit if pattern is None else hit & column.rlike(pattern)
        if s is not None:
            hit = hit & signature.isNotNull() & signature.rlike(s)
        if kinds is not None:
            hit = hit & F.lower(kind).isin(*kinds.split())
        out = F.when(F.coalesce(hit, F.lit(False)), F.lit(result)).otherwise(out)
    return out


def entry_point_kind(language: Column, name: Column, path: Column, signature: Column, kind: Column) -> Column:
    return _first(ENTRY_RULES, language, name, path, signature, kind)


def framework_hint(language: Column, name: Column, path: Column, signature: Column, kind: Column) -> Column:
    return _first(FRAMEWORK_RULES, language, name, path, signature, kind)


#: Files whose parameter types are not checked before a run.
DYNAMIC = r"\.(py|rb|js|jsx|mjs|cjs|php|lua|sh|ex|exs|jl|groovy)$"


def signature_severity(old: Column, new: Column, path: Column) -> Column:
    """How bad a change of signature is for callers.

    Fewer parameters, another order or other names break; more parameters break unless they are appended
    with defaults in a dynamic language; another type breaks in a static language and warns in a dynamic one.
    """

    def params(sig: Column) -> Column:
        inner = F.trim(F.regexp_extract(sig, r"\((.*)\)", 1))
        return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inner, r"\s*,\s*"), lambda s: F.trim(s)))

    def names(p: Column) -> Column:
        return F.transform(p, lambda s: F.trim(F.regexp_extract(s, r"^([^:=]*)", 1)))

    a, b = params(old), params(new)
    dynamic = path.rlike(DYNAMIC)
    added = F.slice(b, F.size(a) + 1, F.greatest(F.size(b) - F.size(a), F.lit(0)))
    appended = (F.slice(b, 1, F.greatest(F.size(a), F.lit(0))) == a) & F.forall(added, lambda s: s.contains("="))
    moved = (F.array_sort(a) == F.array_sort(b)) & (a != b)
    return (
        F.when(F.size(b) > F.size(a), F.when(dynamic & appended, "info").otherwise("breaking"))
        .when(F.size(b) < F.size(a), "breaking").when(moved, "breaking").when(a == b, "warning")
        .otherwise(F.when(dynamic & (names(a) == names(b)), "warning").otherwise("breaking"))
    )


def change_severity(change: Column, old: Column, new: Column, path: Column) -> Column:
    return F.when(change.isin("removed", "export_removed", "renamed", "moved", "visibility_reduced"), "breaking").when(change == "signature_changed", signature_severity(old, new, path)).otherwise("info")


def at_least(severity: Column, least: str) -> Column:
    order = {"info": 0, "warning": 1, "breaking": 2}
    rank = F.when(severity == "breaking", 2).when(severity == "warning", 1).otherwise(0)
    return rank >= order[least]
