"""The set-based cascade against a plain recursive walk over random trees."""

import random
import re

from linetide.functions.globs import PatternSet
from linetide.operators.cascade import VCS, Rules, decide, entry_columns, own_reasons
from linetide.operators.detectors import Detector, Detectors
from linetide.operators.ignore_files import parse_rules, rules_of

NAMES = ["a", "b.go", "c.log", "keep.log", ".h", ".git", "node_modules", "package.json", "vendor", "bundle", "Gemfile", "x.sln", "bin", "CMakeCache.txt", "modules.txt", "composer.json", "build", ".gitignore", "link", "pipe", "obj", "inner.toml"]
LINES = ["*.log", "!keep.log", "/a", "a/", "bin/", "!b.go", "**/b.go", "a/**", "vendor/bundle", "#x", "a/*/c.log", "!a/b.go", "*"]
DETECTORS = Detectors.of([Detector("own", ("inner.*",), ("a", "vendor/b*"))])
RULES = Rules(PatternSet.parse(["a/**/obj", "x.*"]), PatternSet.parse(["*.go", "*.log", "a"]), False, True, DETECTORS)


def tree(rng):
    """Path to kind and ignore-file text."""
    out, texts = {}, {}

    def fill(base, depth):
        for name in rng.sample(NAMES, rng.randrange(1, 9)):
            rel = f"{base}/{name}" if base else name
            kind = "symlink" if name == "link" else "other" if name == "pipe" else "dir" if depth < 4 and ("." not in name or name.startswith((".h", ".git"))) and name != ".gitignore" and rng.random() < 0.8 else "file"
            out[rel] = kind
            if kind == "dir":
                fill(rel, depth + 1)
            elif name == ".gitignore":
                texts[base] = "\n".join(rng.sample(LINES, rng.randrange(1, 5)))

    fill("", 0)
    return out, texts


def hits(pattern, name):
    return re.fullmatch(pattern.replace(".", r"\.").replace("*", ".*"), name) is not None


def walk(entries, texts, tracked):
    """Kept files and decisions, entry by entry."""
    kept, log = set(), {}
    below = {}
    for rel in entries:
        below.setdefault(rel.rpartition("/")[0], []).append(rel)
    dirs = {x for t in tracked for x in ("/".join(t.split("/")[:k]) for k in range(1, t.count("/") + 1))}

    def enter(base, ignores, scopes):
        names = [r.rpartition("/")[2] for r in below.get(base, [])]
        if base:
            own = next((d for d in DETECTORS.active if any(hits(m, n) for m in d.self_markers for n in names) and d.self_name in ("", base.rpartition("/")[2])), None)
            if own:
                log[base] = f"smart: {own.name}"
                return
        if base in texts:
            ignores = [*ignores, (base, parse_rules(texts[base]))]
        rules = [(d.name, x.split("/")) for d in DETECTORS.active if any(hits(m, n) for m in d.markers for n in names) for x in d.exclude]
        scopes = [(base, rules), *scopes] if rules else scopes
        for rel in below.get(base, []):
            name, kind = rel.rpartition("/")[2], entries[rel]
            why = reason(rel, name, kind, ignores, scopes)
            if why:
                if why != "special":
                    log[rel] = why
            elif kind == "dir":
                enter(rel, ignores, scopes)
            else:
                kept.add(rel)

    def reason(rel, name, kind, ignores, scopes):
        if kind == "symlink":
            return "symlink; --follow-symlinks off"
        if kind == "dir" and name in VCS:
            return "vcs metadata"
        if name.startswith("."):
            return "hidden; use --hidden to count"
        raw = RULES.exclude.matched_by(rel)
        if raw:
            return f'excluded by pattern "{raw}"'
        if kind == "dir" and rel not in dirs:
            return "no git-tracked files"
        if kind != "dir" and rel not in tracked:
            return "not tracked by git"
        if kind == "dir":
            for base, rules in scopes:
                sub = rel[len(base) + 1 if base else 0 :].split("/")
                for detector, parts in rules:
                    if len(sub) >= len(parts) and all(hits(p, s) for p, s in zip(parts, sub[-len(parts) :], strict=True)):
                        return f"smart: {detector}"
        decided = None
        for base, rules in ignores:
            sub = rel[len(base) + 1 if base else 0 :]
            for r in rules:
                subject = sub if r["rooted"] else name
                if (kind == "dir" or not r["dir_only"]) and re.search(r["regex"].replace(r"\z", r"\Z"), subject):
                    decided = (r["negate"], f'{base + "/" if base else ""}.gitignore: "{r["raw"]}"')
        if decided and not decided[0]:
            return f"gitignored by {decided[1]}"
        if kind == "other":
            return "special"
        if kind != "dir" and RULES.include.matched_by(rel) is None:
            return "no include pattern matches"
        return None

    enter("", [], [])
    return kept, log


def test_cascade_equals_a_walk(spark):
    rng = random.Random(5)
    trees = [tree(rng) for _ in range(60)]
    tracked = [{r for r, k in e.items() if k != "dir" and rng.random() < 0.8} for e, _ in trees]
    entries = spark.createDataFrame([(k, "", r, r, kind) for k, (e, _) in enumerate(trees) for r, kind in e.items()], "root int, prefix string, abs string, rel string, kind string")
    texts = spark.createDataFrame([(k, d, t) for k, (_, own) in enumerate(trees) for d, t in own.items()], "root int, dir string, content string")
    index = spark.createDataFrame([(k, r) for k, own in enumerate(tracked) for r in own], "root int, rel string")
    kept, log = decide(own_reasons(entry_columns(entries), RULES, rules_of(texts, ["root", "dir"]), index).persist())
    got_kept = {(r["root"], r["rel"]) for r in kept.collect()}
    got_log = {(r["root"], r["rel"]): r["detail"] for r in log.where("reason <> 'special'").collect()}
    want_kept, want_log = set(), {}
    for k, (e, own) in enumerate(trees):
        a, b = walk(e, own, tracked[k])
        want_kept |= {(k, r) for r in a}
        want_log |= {(k, r): v for r, v in b.items()}
    assert got_log == want_log
    assert got_kept == want_kept
    assert len(want_kept) > 50 and len(set(want_log.values())) > 15
