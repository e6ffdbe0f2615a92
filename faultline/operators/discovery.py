"""Components of source trees, from the paths and workspace files of many repositories at once.

Input is a table of files (repo, path, content), content null for all but workspace files. Each file is read once, for
all that it tells: directories, components, patterns. Of a path found by several phases, the first phase and place wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.scalars import trim_space
from faultline.sources.scratch import stored

# Directories that are never components, build files, and parents of components.
EXCLUDED = ["node_modules", "vendor", "venv", ".venv", "target", "build", "dist", ".git", "__pycache__", ".tox", "env"]
BUILD_FILES = ["go.mod", "package.json", "Cargo.toml", "pom.xml", "build.gradle", "build.gradle.kts", "pyproject.toml", "setup.py", "Gemfile", "mix.exs", "build.sbt", "CMakeLists.txt", "composer.json", "pubspec.yaml"]
PARENTS = ["services", "cmd", "apps", "packages", "libs", "modules", "internal"]


def _last(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


#: What a file tells: a directory that is there, the directory of a package, a component, or a pattern of directories.
DIRECTORY, PACKAGE, COMPONENT, PATTERN = range(4)
_FACT = "struct<kind:int,dir:string,phase:int,file:int,place:bigint,name:string,path:string,tracked:boolean>"


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^[./]+|[./]+$", "")


def _glob(pattern: Column) -> Column:
    """A glob as a regular expression; a star does not cross a slash."""
    quoted = F.regexp_replace(F.regexp_replace(pattern, r"^\./|/$", ""), r"([.+^$(){}|\\\[\]])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]")), F.lit("$"))


def _deep(path: Column) -> Column:
    return F.size(F.split(F.regexp_replace(path, r"^\./|/$", ""), "/"))


def _fact(kind: int, directory: Column, phase: int = 0, place: Column | None = None, tracked: bool = False, file: Column | None = None, name: Column | None = None, path: Column | None = None) -> Column:
    """What a file tells of a directory; a component has the directory's last part as its name, unless it has another.

    ``tracked``: it counts only if the directory is there. Of components with one path the first phase, file and place wins.
    """
    named = _last(directory) if name is None else name
    at = F.concat(directory, F.lit("/")) if path is None else path
    fields = {"kind": F.lit(kind), "dir": directory, "phase": F.lit(phase), "file": F.lit(0) if file is None else file, "place": F.lit(0) if place is None else place, "name": named, "path": at, "tracked": F.lit(tracked)}
    return F.struct(*[c.alias(n) for n, c in fields.items()]).cast(_FACT)


def _lines(condition: Column) -> Column:
    """(place, line) of the lines of a file's content, trimmed; nothing unless ``condition`` holds."""
    return F.when(condition, F.transform(F.split("content", "\n"), lambda line, i: F.struct(i.alias("place"), trim_space(line).alias("line"))))


def _parts(lines: Column, separator: str) -> Column:
    """(place, part) of the lines cut at a separator."""
    return F.flatten(F.transform(lines, lambda x: F.transform(F.split(x["line"], separator), lambda part: F.struct(x["place"].alias("place"), part.alias("part")))))


def _facts() -> dict[str, Column]:
    """By rule: an array of what a file (path, content) tells. Each is null or empty for files that the rule is not about."""
    path, parts = F.col("path"), F.split("path", "/")
    depth, part = F.size(parts), lambda i: F.get(parts, F.lit(i))
    out = {}
    out["directories"] = F.when(depth > 1, F.transform(F.sequence(F.lit(1), F.greatest(depth - 1, F.lit(1))), lambda n: _fact(DIRECTORY, F.array_join(F.slice(parts, 1, n), "/"))))

    go = F.filter(_lines(path == "go.work"), lambda x: x["line"].startswith("use ") | x["line"].startswith("./"))
    out["go.work"] = F.transform(go, lambda x: _fact(COMPONENT, _strip(trim_space(F.regexp_replace(x["line"], "^use ", ""))), 10, x["place"]))

    cargo = _lines((path == "Cargo.toml") & F.contains("content", F.lit("[workspace]")))
    cargo = F.filter(cargo, lambda x: F.contains(x["line"], F.lit('"')) & ~x["line"].startswith("#") & ~x["line"].startswith("members"))
    cargo = F.filter(_parts(cargo, '"'), lambda x: ~F.rlike(trim_space(x["part"]), F.lit(r"[\[\]=#,]")))
    out["cargo"] = F.transform(cargo, lambda x: _fact(COMPONENT, trim_space(x["part"]), 11, x["place"], tracked=True))

    package = F.when(path == "package.json", F.try_parse_json("content"))
    workspaces = F.coalesce(F.try_variant_get(package, "$.workspaces.packages", "array<string>"), F.try_variant_get(package, "$.workspaces", "array<string>"))
    out["package.json"] = F.transform(workspaces, lambda x, i: _fact(PATTERN, x, 12, i))

    maven = F.when(path == "pom.xml", F.regexp_extract_all("content", F.lit(r"(?s)<module>(.*?)</module>"), 1))
    out["maven"] = F.transform(maven, lambda x, i: _fact(COMPONENT, trim_space(x), 13, i, tracked=True))

    gradle = F.filter(_lines(path.isin("settings.gradle", "settings.gradle.kts")), lambda x: F.contains(x["line"], F.lit("include")))
    gradle = F.transform(_parts(gradle, "'"), lambda x: F.struct(x["place"].alias("place"), F.regexp_replace(trim_space(x["part"]), "^:", "").alias("part")))
    gradle = F.filter(gradle, lambda x: (x["part"] != "") & ~F.rlike(x["part"], F.lit("[()=,]")))
    out["gradle"] = F.transform(gradle, lambda x: _fact(COMPONENT, F.replace(x["part"], F.lit(":"), F.lit("/")), 14, x["place"], tracked=True, file=path.endswith(".kts").cast("int")))

    solution = F.filter(_lines(path.endswith(".sln") & (depth == 1)), lambda x: F.contains(x["line"], F.lit("Project(")) & F.contains(x["line"], F.lit(".csproj")))
    solution = F.filter(_parts(solution, '"'), lambda x: x["part"].endswith(".csproj") | x["part"].endswith(".fsproj"))
    out["solution"] = F.transform(solution, lambda x: _fact(COMPONENT, F.regexp_extract(F.replace(x["part"], F.lit("\\"), F.lit("/")), r"^(.*)/[^/]*$", 1), 15, x["place"]))

    melos = F.split(F.regexp_extract("content", r"(?m)^\s*packages:[ \t]*\n((?:[ \t]*-.*\n?|[ \t]*\n)*)", 1), "\n")
    melos = F.when(path == "melos.yaml", F.transform(melos, lambda x, i: F.struct(i.alias("place"), trim_space(F.regexp_extract(x, r"^\s*- (.*)$", 1)).alias("pattern"))))
    out["melos"] = F.transform(F.filter(melos, lambda x: x["pattern"] != ""), lambda x: _fact(PATTERN, x["pattern"], 16, x["place"]))
    out["packages"] = F.when(path.endswith("/pubspec.yaml"), F.array(_fact(PACKAGE, F.regexp_extract("path", "^(.*)/[^/]*$", 1))))

    parent = F.array_position(F.array(*map(F.lit, PARENTS)), part(0))
    built = (depth == 3) & part(0).isin(PARENTS) & ~part(1).isin(EXCLUDED) & part(2).isin(BUILD_FILES)
    out["build files"] = F.when(built, F.array(_fact(COMPONENT, F.concat_ws("/", part(0), part(1)), 20, parent)))
    out["mains"] = F.when(F.rlike(path, F.lit(r"^cmd/[^/]+/main\.go$")), F.array(_fact(COMPONENT, F.regexp_replace("path", r"/main\.go$", ""), 30)))
    flutter = trim_space(F.regexp_extract("content", r"(?m)^\s*name:(.*)$", 1))
    out["flutter"] = F.when((path == "pubspec.yaml") & (flutter != ""), F.array(_fact(COMPONENT, F.lit("lib"), 31, tracked=True, name=flutter, path=F.lit("."))))
    docker = (depth == 2) & (part(1) == "Dockerfile") & ~part(0).isin(EXCLUDED)
    out["docker"] = F.when(docker, F.array(_fact(COMPONENT, part(0), 40)))
    return out


def facts(files: DataFrame) -> DataFrame:
    """(repo, kind, dir, phase, file, place, name, path, tracked): all that files tell, each once; one reading of the files."""
    none = F.array().cast(f"array<{_FACT}>")
    told = F.concat(*[F.coalesce(x, none) for x in _facts().values()])
    return files.select("repo", F.inline(told)).distinct()


def components(files: DataFrame) -> DataFrame:
    """(repo, name, path, phase) of every component.

    The files are read once. What they tell is stored and grouped by repository and directory, so no repository is held
    by one task, however many files it has; patterns meet the directories of their own depth alone.
    """
    told = stored(facts(files), "discovery")
    patterns = told.filter(F.col("kind") == PATTERN).select("repo", F.col("phase").alias("_phase"), F.col("place").alias("_place"), _deep(F.col("dir")).alias("_depth"), _glob(F.col("dir")).alias("_regex"))
    # Patterns of one kind of file are about packages, the others about directories.
    wanted = F.when(F.col("_phase") == 16, F.lit(PACKAGE)).otherwise(F.lit(DIRECTORY))
    near = told.filter(F.col("kind").isin(DIRECTORY, PACKAGE)).withColumn("_depth", _deep(F.col("dir")))
    globbed = near.join(patterns, ["repo", "_depth"]).filter((F.col("kind") == wanted) & F.regexp_like("dir", F.col("_regex")))
    globbed = globbed.select("repo", _fact(COMPONENT, F.col("dir"), 0, F.col("_place")).alias("f"), "_phase").select("repo", "f.*", "_phase").withColumn("phase", F.col("_phase")).drop("_phase")
    rows = told.filter(F.col("kind").isin(DIRECTORY, COMPONENT)).unionByName(globbed).filter("dir <> '' and dir <> '.'")
    # A directory's first component, if it needs no directory or there is one; the one of another path apart.
    own = F.struct("phase", "file", "place", "name", "path")
    first = lambda condition: F.min(F.when((F.col("kind") == COMPONENT) & condition, own))
    elsewhere = F.col("path") != F.concat("dir", F.lit("/"))
    found = rows.groupBy("repo", "dir").agg(F.bool_or(F.col("kind") == DIRECTORY).alias("there"), first(~F.col("tracked")).alias("free"), first(F.col("tracked") & ~elsewhere).alias("bound"), first(F.col("tracked") & elsewhere).alias("other"))
    held = lambda c: F.when(F.col("there"), F.col(c))
    best = F.filter(F.array(F.least("free", held("bound")), held("other")), lambda x: x.isNotNull())
    return found.select("repo", F.explode(best).alias("c")).select("repo", "c.name", "c.path", "c.phase")


def with_fallback(found: DataFrame, projects: DataFrame) -> DataFrame:
    """Components, and (project, ".") for repositories (repo, project) that have none."""
    none = projects.join(found.select("repo").distinct(), "repo", "left_anti").select("repo", F.col("project").alias("name"), F.lit(".").alias("path"), F.lit(50).alias("phase"))
    return found.unionByName(none)


# The files at a root that speak for a language, and patterns of files there or one level below.
LANGUAGES = {
    "Go": ["go.mod", "go.work"],
    "Java": ["pom.xml", "build.gradle", "build.gradle.kts"],
    "Python": ["pyproject.toml", "setup.py", "requirements.txt", "Pipfile"],
    "Rust": ["Cargo.toml"],
    "Ruby": ["Gemfile"],
    "JavaScript": ["package.json"],
    "TypeScript": ["tsconfig.json"],
    "C#": [],
    "C/C++": ["CMakeLists.txt"],
    "PHP": ["composer.json"],
    "Elixir": ["mix.exs"],
    "Scala": ["build.sbt"],
    "Dart": ["pubspec.yaml"],
}
LANGUAGE_SUFFIXES = {"C#": ".csproj", "Ruby": ".gemspec"}
SOLUTION_SUFFIX, SOLUTION_LANGUAGE = ".sln", "C#"


def languages(files: DataFrame) -> DataFrame:
    """(repo, language), each language of a repository once, by the files at its root or, for two of them, one level below."""
    path, deep = F.col("path"), F.size(F.split("path", "/"))
    by_name = F.lit(None).cast("string")
    for language, names in LANGUAGES.items():
        if names:
            by_name = F.when(path.isin(names), language).otherwise(by_name)
    found = by_name
    for language, suffix in LANGUAGE_SUFFIXES.items():
        found = F.when((deep <= 2) & path.endswith(suffix), language).otherwise(found)
    found = F.when((deep == 1) & path.endswith(SOLUTION_SUFFIX), SOLUTION_LANGUAGE).otherwise(found)
    return files.select("repo", found.alias("language")).filter("language is not null").distinct()
