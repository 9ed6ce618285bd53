"""Scalar functions as Column expressions; all stay inside generated code."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom import model


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _case(key: Column, table: Mapping[str, object], default=None) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


# --- identity


def truncated_hash(x) -> Column:
    """The first 12 hex digits of the SHA-256."""
    return F.substring(F.sha2(_c(x).cast("binary"), 256), 1, 12)


def normalized_repo_key(url) -> Column:
    """One key for all ways to write a clone URL: no scheme, credentials, .git or closing slash; lower case."""
    x = F.lower(F.trim(_c(url)))
    x = F.regexp_replace(x, r"^[a-z+]+://", "")
    x = F.regexp_replace(x, r"^[^@/]*@", "")
    x = F.regexp_replace(x, r"^([^/:]+):(?!\d)", "$1/")
    return F.regexp_replace(F.regexp_replace(x, r"/+$", ""), r"\.git$", "")


def repo_uid(instance, url) -> Column:
    return F.concat(F.lit("repo:"), _c(instance), F.lit(":"), truncated_hash(normalized_repo_key(url)))


def file_uid(repo, path) -> Column:
    return F.concat(F.lit("file:"), _c(repo), F.lit(":"), truncated_hash(path))


def symbol_uid(repo, path, name, line) -> Column:
    return F.concat_ws(":", F.lit("sym"), _c(repo), truncated_hash(path), truncated_hash(name), _c(line).cast("string"))


def canonical_symbol_id(url, path, name, scope) -> Column:
    scope = F.when(_c(scope) == "", _c(name)).otherwise(_c(scope))
    return F.concat(truncated_hash(normalized_repo_key(url)), F.lit(":"), _c(path), F.lit("#"), _c(name), F.lit(":"), truncated_hash(scope))


def vault_uid(instance, root) -> Column:
    return F.concat(F.lit("vlt:"), _c(instance), F.lit(":"), truncated_hash(root))


def note_uid(vault, path) -> Column:
    return F.concat(F.lit("note:"), _c(vault), F.lit(":"), truncated_hash(path))


def heading_uid(note, slug, line) -> Column:
    return F.concat_ws(":", F.lit("head"), _c(note), truncated_hash(slug), _c(line).cast("string"))


def section_uid(note, line, short_hash) -> Column:
    return F.concat_ws(":", F.lit("sec"), _c(note), _c(line).cast("string"), _c(short_hash))


def tag_uid(vault, name) -> Column:
    return F.concat(F.lit("tag:"), _c(vault), F.lit(":"), truncated_hash(F.lower(_c(name))))


def uid_kind(uid) -> Column:
    return _case(F.substring_index(_c(uid), ":", 1), model.UID_KINDS)


def normalize_http_path(path) -> Column:
    """One leading slash, no closing or repeated ones, every parameter slot as {}."""
    parts = F.filter(F.transform(F.split(F.trim(_c(path)), "/"), lambda s: F.trim(s)), lambda s: s != "")
    slot = r"^(\{.*\}|\$\{.*\}|:.*|<.*>)$"
    return F.concat(F.lit("/"), F.array_join(F.transform(parts, lambda s: F.when(s.rlike(slot), F.lit("{}")).otherwise(s)), "/"))


# --- confidence and scores


def confidence_score(match_type, language) -> Column:
    base = _case(_c(match_type), model.MATCH_BASE, 0.0)
    change = F.lit(0.0)
    for kind, steps in model.MATCH_MODIFIER.items():
        for step, names in steps.items():
            change = F.when((_c(match_type) == kind) & _c(language).isin(*names.split()), F.lit(step)).otherwise(change)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + change))


def activity_multiplier(score, weight: float = 1.2) -> Column:
    # least and greatest pass over nulls, so the null is taken first
    return F.when(_c(score).isNull(), 1.0).otherwise(F.greatest(F.lit(0.4), F.least(F.lit(1.6), 1 + weight * (_c(score) - 0.5))))


def org_severity(score) -> Column:
    return F.when(_c(score) >= 0.5, "breaking").when(_c(score) >= 0.25, "warning").otherwise("info")


def risk_level(affected, clusters, central) -> Column:
    n = F.when(_c(affected) < 10, 0).when(_c(affected) < 50, 1).when(_c(affected) < 200, 2).otherwise(3)
    n = n + F.when(_c(central), 1).otherwise(0) + F.when(_c(clusters) > 3, 1).otherwise(0)
    return F.when(n == 0, "low").when(n == 1, "medium").otherwise("high")


def max_edit_distance(length) -> Column:
    return F.when(_c(length) <= 2, 0).when(_c(length) <= 4, 1).otherwise(2)


def mention_confidence(kind, in_code, n_files) -> Column:
    """Base of the kind, times the evidence, over the files that define the name."""
    return _case(_c(kind), model.MENTION_BASE, 0.8) * F.when(_c(in_code), 1.0).otherwise(0.85) / _c(n_files)


def dead_code_confidence(visibility, weakly_reached) -> Column:
    return F.when(_c(weakly_reached), "medium").when(_c(visibility) == "public", "low").otherwise("medium")


def decayed_score(access, seeds, used, shown, terminal, sessions, days, changed=None) -> Column:
    raw = F.log1p(_c(access) * 0.3 + _c(seeds) * 0.5 + _c(used) * 1.0 + _c(shown) * 0.1 + _c(terminal) * 1.5)
    penalty = F.lit(1.0) if changed is None else F.when(_c(changed), 0.5).otherwise(1.0)
    return F.greatest(raw * F.exp(-0.05 * _c(days)) * penalty, F.when(_c(sessions) >= 3, 0.1).otherwise(0.0))


def poll_interval(seconds_since_commit) -> Column:
    """Half of the time since the last commit, from 45 seconds to 8 hours."""
    return F.greatest(F.lit(45.0), F.least(F.lit(28800.0), _c(seconds_since_commit) / 2))


# --- text


def slugify(text) -> Column:
    x = F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{Nd}\p{Nl}\p{No} _-]", "")
    return F.regexp_replace(F.regexp_replace(x, r"[ _-]+", "-"), r"^-|-$", "")


def normalize_key(text) -> Column:
    return F.trim(F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{N}]+", " "))


def note_stem(path) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(_c(path), r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", ""))


def is_distinctive(name) -> Column:
    """snake_case or at least two humps: not an English word."""
    core = F.regexp_replace(_c(name), r"^_+|_+$", "")
    return (core.contains("_") & core.rlike("[A-Za-z]")) | _c(name).rlike("[a-z0-9][A-Z]")


def is_noise(name) -> Column:
    return (F.length(_c(name)) < 3) | ((F.length(_c(name)) <= 6) & _c(name).rlike("^[a-z0-9]+$"))


def split_identifier(name) -> Column:
    """Words of a camelCase, snake_case or qualified name, in lower case."""
    x = F.regexp_replace(_c(name), r"[:./\\_]+", " ")
    x = F.regexp_replace(x, r"(\p{Ll})(\p{Lu})", "$1 $2")
    x = F.regexp_replace(x, r"(\P{Z})(\p{Lu}\p{Ll})", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(x), r" +", " "))


def symbol_embed_text(kind, name, doc=None) -> Column:
    return F.concat_ws(" ", F.lower(_c(kind)), split_identifier(name), *([F.substring(_c(doc), 1, 256)] if doc is not None else []))


def missing_anchor(link) -> Column:
    """The anchor of `Note#anchor`; null without a note part or an anchor."""
    note, anchor = F.trim(F.substring_index(_c(link), "#", 1)), F.trim(F.regexp_extract(_c(link), r"#(.*)$", 1))
    return F.when(_c(link).contains("#") & (note != "") & (anchor != ""), anchor)


def iso_epoch(text) -> Column:
    """Seconds since 1970 of an ISO 8601 date or time; 0 when it is none."""
    x = F.trim(_c(text))
    parsed = F.coalesce(F.try_to_timestamp(x, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(x, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(x, F.lit("yyyy-MM-dd")), F.try_to_timestamp(x))
    return F.coalesce(F.greatest(F.lit(0.0), F.unix_micros(parsed) / 1e6), F.lit(0.0))


def edge_type(text) -> Column:
    x = F.translate(F.upper(F.trim(_c(text))), "- ", "__")
    return F.when(x.isin("DEPENDSON", "DEPENDS"), "DEPENDS_ON").when(x == "CAUSEDBY", "CAUSED_BY").when(x.isin("RELATESTO", "RELATED"), "RELATES_TO").otherwise(x)


def heading_edge_type(heading) -> Column:
    x = F.lower(F.trim(_c(heading)))
    return F.when(x == "supersedes", "SUPERSEDES").when(x.isin("depends on", "depends", "dependencies"), "DEPENDS_ON").when(x.isin("see also", "related"), "RELATES_TO")


def frontmatter_refs(json, key: str) -> Column:
    """The strings under a key that holds one string or a list of them."""
    many = F.from_json(F.get_json_object(_c(json), f"$.{key}"), "array<string>")
    return F.coalesce(F.when(F.get_json_object(_c(json), f"$.{key}").startswith("["), many), F.when(F.get_json_object(_c(json), f"$.{key}").isNotNull(), F.array(F.get_json_object(_c(json), f"$.{key}"))), F.array().cast("array<string>"))


def trigrams(text) -> Column:
    x = F.lower(_c(text))
    return F.when(F.length(x) < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - 2), lambda i: x.substr(i, F.lit(3)))))


def parameter_count(signature) -> Column:
    inner = F.trim(F.regexp_extract(_c(signature), r"\((.*)\)", 1))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, ",")))


# --- paths


def micros(ts) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone."""
    return F.unix_micros(_c(ts).cast("timestamp"))


def file_name(path) -> Column:
    return F.regexp_extract(F.translate(_c(path), "\\", "/"), r"([^/]*)$", 1)


def language(path) -> Column:
    ext = F.regexp_extract(file_name(path), r".\.([^.]+)$", 1)
    return _case(ext, {e: name for name, exts in model.LANGUAGE_OF.items() for e in exts.split()})


#: Names of test files by language.
TEST_FILE = r"(^|/)(tests|__tests__)(/|$)|\.(test|spec)\.[^/]*$|_test\.(go|exs|dart|rb|py)$|_spec\.rb$|(^|/)test_[^/]*\.py$|Tests?\.(java|cs)$|Test\.(kt|php)$|Tests\.swift$|(Test|Spec)\.(scala|groovy)$"


def is_test_file(path) -> Column:
    return F.translate(_c(path), "\\", "/").rlike(TEST_FILE)


def changed_file_class(path) -> Column:
    name, p = file_name(path), F.translate(_c(path), "\\", "/")
    ext = F.regexp_extract(name, r".\.([^.]+)$", 1)
    folder = F.exists(F.split(p, "/"), lambda s: s.isin(*model.BUILD_FOLDERS))
    build = folder | name.isin(*model.BUILD_FILES) | name.rlike(r"^Dockerfile\.|^\.env|\.config\.|\.generated\.|\.gen\.|\.g\.cs$|\.pb\.(go|cc|h)$") | ext.isin(*model.BUILD_EXTENSIONS)
    return F.when(build, "execution").when(ext.isin("md", "markdown"), "documentation").when(language(path).isNotNull(), "source").otherwise("unknown")


def path_factor(path, rules: Iterable[tuple] = model.PATH_DEBOOST) -> Column:
    out = F.lit(1.0)
    low = F.concat(F.lit("/"), F.lower(_c(path)))
    for prefix, suffix, factor in rules:
        out = out * F.when(low.contains(prefix) if prefix else _c(path).endswith(suffix), factor).otherwise(1.0)
    return out


def kind_rank(kind, priority: Iterable[str] = model.KIND_PRIORITY) -> Column:
    names = list(priority)
    return _case(_c(kind), {k: i for i, k in enumerate(names)}, 1 << 30)


def note_path_matches(path, query: str) -> Column:
    p, q = F.lower(_c(path)), query.lower()
    tries = {q, q.removesuffix(".md") + ".md"}
    out = F.lit(False)
    for t in sorted(tries):
        out = out | (p == t) | p.endswith("/" + t)
    return out


def note_in_folder(path, folder: str) -> Column:
    return _c(path).startswith(folder.rstrip("/") + "/")


def tag_matches(tag, focus: str) -> Column:
    """The tag itself or one below it; `project` is not a parent of `projects`."""
    f = focus.lstrip("#").lower()
    return (F.lower(_c(tag)) == f) | F.lower(_c(tag)).startswith(f + "/")


def is_allowlisted(path, title, allowlist: Iterable[str]) -> Column:
    p, t = F.translate(F.lower(_c(path)), "\\", "/"), F.lower(_c(title))
    out = F.lit(False)
    for entry in (e.lower().replace("\\", "/") for e in allowlist if e):
        out = out | ((p == entry) | p.endswith("/" + entry) | (t == entry) if "." in entry or "/" in entry else p.contains(entry) | t.contains(entry))
    return out


def is_entry_name(name) -> Column:
    low = F.lower(_c(name))
    return low.isin(*model.ENTRY_NAMES) | low.rlike("_(" + "|".join(model.ENTRY_NAMES) + ")$")


def process_name(kind, name, path) -> Column:
    k = _c(kind)
    folder = F.coalesce(F.nullif(F.regexp_extract(_c(path), r"([^/]+)/[^/]*$", 1), F.lit("")), F.lit("root"))
    own = _case(k, {"TestEntry": "test", "LambdaHandler": "lambda", "EventListener": "event", "CronJob": "cron", "CliCommand": "cli"})
    return (
        F.when(k == "HttpHandler", F.concat(F.lit("http:"), file_name(path), F.lit("::"), _c(name)))
        .when(k == "Main", F.concat(folder, F.lit("::main")))
        .when(k == "ModuleInit", F.concat(file_name(path), F.lit("::"), _c(name)))
        .otherwise(F.concat(F.coalesce(own, F.lit("process")), F.lit("::"), _c(name)))
    )


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression: ** spans folders, * and ? stay within one."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] in "*?":
            out, i = out + ("[^/]*" if glob[i] == "*" else "[^/]"), i + 1
        else:
            out, i = out + ("\\" + glob[i] if glob[i] in ".+()[]{}^$|\\" else glob[i]), i + 1
    return f"^{out}$"


def ranking_prior(location, rules: Iterable[tuple[str, float]]) -> Column:
    """The multiplier of the last rule that matches the path; null when none does."""
    path = F.regexp_replace(_c(location), r":\d+$", "")
    out = F.lit(None).cast("double")
    for glob, multiplier in rules:
        out = F.when(path.rlike(glob_regex(glob)), F.lit(float(multiplier))).otherwise(out)
    return out


def hub_role(n_in, n_out) -> Column:
    i, o = _c(n_in), _c(n_out)
    return F.when((i == 0) & (o == 0), "isolated").when(i >= 3 * o, "sink").when(o >= 3 * i, "orchestrator").otherwise("bridge")


def recommendation(complete, needs_tests, n_selected) -> Column:
    return F.when(~_c(complete) | (_c(needs_tests) & (_c(n_selected) == 0)), "run-full-suite").when(_c(n_selected) == 0, "no-tests-needed").otherwise("run-selected")
