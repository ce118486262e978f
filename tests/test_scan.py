"""Whole scans of small trees."""

import io
import json
import subprocess

import pytest

from linetide.cli import main


def tree(base, files):
    for name, content in files.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())


def run(spark, *arguments):
    out, err = io.StringIO(), io.StringIO()
    code = main(["--no-config", *map(str, arguments)], out, err, spark)
    return code, out.getvalue(), err.getvalue()


def counts(spark, *arguments):
    code, out, err = run(spark, "-f", "json", *arguments)
    assert code == 0, err
    found = json.loads(out)
    return {x["name"]: (x["files"], x["code"]) for x in found["languages"]}, [(x["path"], x["detector"]) for x in found["excluded"]], found


FILES = {
    "main.go": "package main\n\n// c\nfunc main() {}\n", "README.md": "# t\n", ".gitignore": "ignored.go\n", "ignored.go": "package x\n",
    ".hidden/h.go": "package h\n", "app/composer.json": "{}\n", "app/index.php": "<?php echo 1;\n", "app/vendor/x.php": "<?php\n",
    "env/pyvenv.cfg": "x\n", "env/lib/a.py": "a\n", "tool.py": "x = 1\n", "noext": "#!/usr/bin/env bash\necho hi\n", "bin.go": b"a\0b", "data.xyz": "q\n",
    "pkg/__init__.py": "y = 2\n",
}


def test_defaults(spark, tmp_path):
    tree(tmp_path, FILES)
    found, excluded, report = counts(spark, tmp_path)
    assert found == {"Go": (1, 2), "Python": (2, 2), "Markdown": (1, 1), "JSON": (1, 1), "PHP": (1, 1), "Shell": (1, 1)}
    assert [(p.removeprefix(f"{tmp_path}/"), d) for p, d in excluded] == [("app/vendor", "composer"), ("env", "venv")]
    assert report["totals"]["files"] == 7


def test_flags_and_traces(spark, tmp_path):
    tree(tmp_path, FILES)
    assert counts(spark, "--hidden", "--no-gitignore", "--no-smart", tmp_path)[0]["Go"] == (3, 4)
    assert counts(spark, "--ext", "py", tmp_path)[0] == {"Python": (2, 2)}
    assert counts(spark, "-l", "go,shell", tmp_path)[0] == {"Go": (1, 2), "Shell": (1, 1)}
    assert counts(spark, "-e", "app", "-e", "./pkg/", "-i", "*.py", "-i", "*.go", tmp_path)[0] == {"Go": (1, 2), "Python": (1, 1)}
    code, _, err = run(spark, "-vvv", "-e", "tool.*", tmp_path)
    lines = {x.replace(f"{tmp_path}/", "") for x in err.splitlines()}
    assert code == 0
    assert {
        'linetide: skip ignored.go (gitignored by .gitignore: "ignored.go")', "linetide: skip .hidden (hidden; use --hidden to count)",
        'linetide: skip tool.py (excluded by pattern "tool.*")', "linetide: skip app/vendor (smart: composer)", "linetide: skip data.xyz (unknown language)",
        "linetide: count noext (Shell)", "linetide: skipping binary file bin.go",
    } <= lines


def test_overlap_dedup_and_file_roots(spark, tmp_path):
    tree(tmp_path, {"a/x.go": "package a\n", "b/y.go": "package a\n", "b/z.py": "z\n"})
    assert counts(spark, tmp_path, tmp_path / "b")[0] == {"Go": (2, 2), "Python": (1, 1)}
    found, _, report = counts(spark, "--dedup", "--by-file", tmp_path)
    assert found == {"Go": (1, 1), "Python": (1, 1)}
    assert [d["path"] for x in report["languages"] for d in x["files_detail"]] == [f"{tmp_path}/a/x.go", f"{tmp_path}/b/z.py"]
    assert counts(spark, tmp_path / "a" / "x.go")[0] == {"Go": (1, 1)}
    code, _, err = run(spark, tmp_path / "none")
    assert code == 1 and "cannot read" in err


def test_symlinks(spark, tmp_path):
    tree(tmp_path, {"real/a.go": "package a\n"})
    (tmp_path / "link").symlink_to(tmp_path / "real")
    (tmp_path / "real" / "loop").symlink_to(tmp_path)
    assert counts(spark, tmp_path)[0] == {"Go": (1, 1)}
    assert counts(spark, "--follow-symlinks", tmp_path)[0] == {"Go": (1, 1)}


def test_git(spark, tmp_path):
    def git(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)

    tree(tmp_path, {"a.go": "package a\n", "b.go": "package b\n", "vendor/composer.json": "{}\n"})
    git("init", "-q")
    git("add", "a.go", "vendor")
    git("commit", "-qm", "x")
    tree(tmp_path, {"a.go": "package a\nvar x = 1\n", "c.py": "c\n"})
    want = {"Go": (1, 2), "JSON": (1, 1)}
    assert counts(spark, "--tracked", tmp_path)[0] == want
    assert counts(spark, "--git", tmp_path)[0] == want


def test_listings_and_errors(spark, tmp_path):
    assert len(run(spark, "--list-languages")[1].splitlines()) == 151
    assert run(spark, "--list-detectors")[1].splitlines()[0] == "node: markers [package.json] -> exclude [node_modules .pnpm-store bower_components]"
    for bad in (["-f", "x", "."], ["-l", "nope", "."], ["--no-detect", "nope", "."], ["-e", "../x", "."], ["--nope"]):
        assert run(spark, *bad)[0] == 1
    (tmp_path / "c.yml").write_text("definitions:\n  FooLang:\n    extensions: [foo]\n    line_comments: ['%%']\ndetectors:\n  custom:\n  - {name: mytool, markers: [my.toml], exclude: [mycache]}\n")
    tree(tmp_path / "t", {"a.foo": "%% c\ncode\n", "my.toml": "", "mycache/b.foo": "x\n"})
    out, err = io.StringIO(), io.StringIO()
    assert main(["--config", str(tmp_path / "c.yml"), "-f", "json", str(tmp_path / "t")], out, err, spark) == 0, err.getvalue()
    found = json.loads(out.getvalue())
    assert [(x["name"], x["code"], x["comment"]) for x in found["languages"] if x["name"] == "FooLang"] == [("FooLang", 1, 1)]
    (tmp_path / "d.yml").write_text("nope: 1\n")
    assert main(["--config", str(tmp_path / "d.yml"), "."], out, err, spark) == 1


@pytest.mark.parametrize("format_", ["table", "yaml"])
def test_formats(spark, tmp_path, format_):
    tree(tmp_path, {"a.go": "package a\n"})
    code, out, _ = run(spark, "-f", format_, "-o", tmp_path / "out", tmp_path)
    text = (tmp_path / "out").read_text()
    assert code == 0 and out == ""
    assert ("Go                               1           0           0           1\n" if format_ == "table" else "languages:\n  - name: Go\n    files: 1\n") in text
