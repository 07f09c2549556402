"""Ignore files against a plain walk with a matcher of its own."""

import os
import random

from tessella.sources import ignore

SKIP = {*ignore.SKIP_DIRS, *ignore.SKIP_BUILD_DIRS}


def name_fits(glob, name):
    """A name against one part of a glob, by trying."""
    if not glob:
        return not name
    c = glob[0]
    if c == "{" and "}" in glob:
        end = glob.index("}")
        return any(name_fits(way + glob[end + 1 :], name) for way in glob[1:end].split(","))
    if c == "*":
        return name_fits(glob[1:], name) or (name != "" and name_fits(glob, name[1:]))
    if not name:
        return False
    if c == "?":
        return name_fits(glob[1:], name[1:])
    if c == "[" and "]" in glob[3 if glob[1] in "!^" else 2 :]:
        end = glob.index("]", 3 if glob[1] in "!^" else 2)
        body = glob[1:end]
        no, body = body[0] in "!^", body.lstrip("!^")
        one, hit = 0, False
        while one < len(body):
            if body[one + 1 : one + 2] == "-" and one + 2 < len(body):
                hit |= body[one] <= name[0] <= body[one + 2]
                one += 3
            else:
                hit |= body[one] == name[0]
                one += 1
        return hit != no and name_fits(glob[end + 1 :], name[1:])
    if c == "\\" and len(glob) > 1:
        return glob[1] == name[0] and name_fits(glob[2:], name[1:])
    return c == name[0] and name_fits(glob[1:], name[1:])


def path_fits(parts, names):
    if not parts:
        return not names
    if parts[0] == "**":
        if len(parts) == 1:
            return True
        return any(path_fits(parts[1:], names[k:]) for k in range(len(names) + 1))
    return bool(names) and name_fits(parts[0], names[0]) and path_fits(parts[1:], names[1:])


def rule_of(line):
    line = line if line.endswith("\\ ") else line.rstrip()
    if not line or line[0] == "#":
        return None
    escaped = line[:2] in ("\\!", "\\#")
    no = not escaped and line[0] == "!"
    line = line[1:] if escaped or no else line
    rooted = line[:1] == "/"
    line = line[rooted:]
    only = line[-1:] == "/"
    line = line[: len(line) - only]
    if not line:
        return None
    parts = line.split("/")
    if not rooted and len(parts) == 1:
        parts = ["**", *parts]
    if parts[-1] == "**" and len(parts) > 1:
        parts.append("*")
    return parts, no, only


def lines_of(path):
    try:
        with open(path, encoding="utf-8") as f:
            return [r for r in map(rule_of, f.read().split("\n")) if r]
    except FileNotFoundError:
        return []


def plain_walk(root):
    found = set()

    def ignored(parents, path, is_dir):
        for kind in (2, 1, 0):
            in_repository = True
            if kind < 2 and not any(os.path.exists(os.path.join(root, d, ".git")) for d in parents):
                continue
            for d in reversed(parents):
                if kind == 2 or in_repository:
                    below = path[len(d) + bool(d) :].split("/")
                    for parts, no, only in reversed(lines_of(os.path.join(root, d, ignore.KINDS[kind])) if kind or os.path.isdir(os.path.join(root, d, ".git")) else []):
                        if (is_dir or not only) and path_fits(parts, below):
                            return not no
                in_repository &= not os.path.exists(os.path.join(root, d, ".git"))
        return False

    def down(folder, parents):
        for name in os.listdir(os.path.join(root, folder)):
            path = f"{folder}/{name}" if folder else name
            is_dir = os.path.isdir(os.path.join(root, path))
            if os.path.islink(os.path.join(root, path)) and is_dir or ignored(parents, path, is_dir):
                continue
            if not is_dir:
                found.add(path)
            elif name not in SKIP:
                down(path, [*parents, path])

    down("", [""])
    return found


def put(root, files):
    for path, text in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w", encoding="utf-8") as f:
            f.write(text)


def scanned(spark, roots):
    rows = ignore.scan(spark.createDataFrame(list(roots.items()), "model string, root string")).collect()
    assert len({(r.model, r.path) for r in rows}) == len(rows)
    return {m: {r.path for r in rows if r.model == m} for m in roots}


def test_nested_files_negation_and_closed_directories(spark, tmp_path):
    files = {
        ".git/HEAD": "", ".git/info/exclude": "secret.txt\nb.log\n",
        ".gitignore": "# logs\n*.log\n!keep.log\n/top.txt\ntmp/\n!tmp/again.txt\na/**/z.txt\ndocs/**\n*.bak  \n\\#odd\n\\!odd\nname\\ \nx[0-9].c\nv{1,2}.h\nq?.t\n",
        "a.log": "", "keep.log": "", "top.txt": "", "sub/top.txt": "", "tmp/again.txt": "", "sub/tmp/x.txt": "", "tmpx/a": "",
        "a/z.txt": "", "a/b/c/z.txt": "", "b/a/z.txt": "", "docs/x.md": "", "docs/y/z.md": "", "old.bak": "", "#odd": "", "!odd": "", "name ": "",
        "x1.c": "", "xa.c": "", "v1.h": "", "v3.h": "", "qq.t": "", "q.t": "", ".hidden/.env": "", ".github/workflows/ci.yml": "", "secret.txt": "", "b.log": "",
        "sub/.gitignore": "!a.log\n*.md\n", "sub/a.log": "", "sub/r.md": "", "sub/deep/r.md": "", "sub/.ignore": "!r.md\nkeep.log\n", "sub/keep.log": "",
        "inner/.git/HEAD": "", "inner/c.log": "", "inner/.gitignore": "d.txt\n", "inner/d.txt": "", "inner/down/e.log": "", "node_modules/m.js": "", "lib/dist/o.js": "",
    }
    put(tmp_path / "repo", files)
    os.symlink(tmp_path / "repo", tmp_path / "repo" / "loop")
    plain = {k: v for k, v in files.items() if not k.startswith((".git/", "inner/.git/"))}
    put(tmp_path / "bare", plain)
    roots = {"repo": str(tmp_path / "repo"), "bare": f"file://{tmp_path}/bare"}
    got = scanned(spark, roots)
    assert got == {"repo": plain_walk(roots["repo"]), "bare": plain_walk(str(tmp_path / "bare"))}
    assert {"keep.log", "sub/a.log", "sub/r.md", "inner/c.log", ".hidden/.env", "b/a/z.txt"} <= got["repo"]
    assert {"a.log", "tmp/again.txt", "sub/keep.log", "a/b/c/z.txt", "docs/x.md", "secret.txt", "inner/d.txt", "node_modules/m.js", "name ", "#odd"}.isdisjoint(got["repo"])
    assert "a.log" in got["bare"] and "sub/keep.log" not in got["bare"]


def test_random_trees(spark, tmp_path):
    rng = random.Random(9)
    names = ["a", "b", "ab", "c.x", "d.y", ".h", "a b", "é"]
    globs = ["a", "*", "*.x", "b/", "/a", "a/b", "**/c.x", "a/**", "**/a/", "?", "[ab]", "[!a]*", "{a,d.y}", "a*", "/b/*.y", ".h", "a\\ b", "\\a", "*é", "a/**/b", "**"]
    roots = {}
    for t in range(6):
        files = {}
        for _ in range(60):
            path = "/".join(rng.choice(names) + "_" * (d < 2 and rng.random() < 0.1) for d in range(rng.randrange(1, 5)))
            if not any(path.startswith(p + "/") or p.startswith(path + "/") or p == path for p in files):
                files[path] = ""
        folders = {os.path.dirname(p) for p in files}
        folders |= {os.path.dirname(p) for p in folders} | {""}
        for f in sorted(folders):
            for kind in (".gitignore", ".ignore"):
                if rng.random() < 0.5:
                    lines = ["!" * (rng.random() < 0.35) + rng.choice(globs) for _ in range(rng.randrange(1, 5))]
                    files[f"{f}/{kind}".lstrip("/")] = "\n".join(lines)
            if rng.random() < (0.9 if not f else 0.15):
                files[f"{f}/.git/HEAD".lstrip("/")] = ""
        put(tmp_path / f"t{t}", files)
        roots[f"t{t}"] = str(tmp_path / f"t{t}")
    assert scanned(spark, roots) == {m: plain_walk(r) for m, r in roots.items()}


def test_no_directory_and_no_rules(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "f").write_text("")
    assert scanned(spark, {"one": str(tmp_path / "one"), "two": str(tmp_path / "two"), "gone": str(tmp_path / "gone")}) == {"one": set(), "two": {"f"}, "gone": set()}
