"""Ignore files against verdicts written down by hand."""

from apiquarry.sources import ignore

SCHEMA = "project_id string, path string, content string"


def kept(spark, rules, paths, folder=""):
    rows = [("p", folder + ".gitignore", rules)] + [("p", p, "x") for p in paths]
    out = ignore.without_ignored(spark.createDataFrame(rows, SCHEMA)).select("path").collect()
    return {r.path for r in out} - {folder + ".gitignore"}


def test_patterns(spark):
    cases = [
        ("*.log", ["a.log", "d/e/b.log", "a.logs"], {"a.logs"}),
        ("/top", ["top", "d/top"], {"d/top"}),
        ("build/", ["build/x", "d/build/x", "e/build"], {"e/build"}),
        ("a/b", ["a/b/c", "x/a/b"], {"x/a/b"}),
        ("**/gen", ["gen/x", "d/e/gen", "agen"], {"agen"}),
        ("d/**", ["d/x", "d/e/y", "e/d"], {"e/d"}),
        ("a/**/b", ["a/b", "a/x/b", "a/x/y/b", "a/bb"], {"a/bb"}),
        ("f?.c", ["f1.c", "f12.c", "f.c"], {"f12.c", "f.c"}),
        ("[!a-c]x", ["ax", "dx", "x"], {"ax", "x"}),
        ("[z-a]x\n[q", ["ax", "[q"], {"ax"}),
        ("# no\n\\#yes\n\\!bang\n", ["# no", "#yes", "!bang"], {"# no"}),
        ("sp  \nkeep\\ \r\n", ["sp", "keep ", "keep"], {"keep"}),
        ("a+(b).$", ["a+(b).$", "aa(b).$"], {"aa(b).$"}),
        ("*.md\n!b.md\nb.md\n!b.md", ["a.md", "b.md"], {"b.md"}),
        ("out\n!out/keep", ["out/keep", "in/keep"], {"in/keep"}),
        ("", ["a"], {"a"}),
    ]
    for rules, paths, want in cases:
        assert kept(spark, rules, paths) == want, rules


def test_deeper_files_win_and_projects_stay_apart(spark):
    rows = [
        ("p", ".gitignore", "*.gen\n!w/never"), ("p", "w/.gitignore", "!*.gen\nx"), ("p", "a.gen", ""), ("p", "w/a.gen", ""), ("p", "w/d/x", ""), ("p", "x", ""),
        ("q", "a.gen", ""), ("q", ".gitignore", None), (None, "a.gen", ""), ("p", None, ""),
    ]
    out = ignore.without_ignored(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["project_id", "path", "content"]
    assert {(r.project_id, r.path) for r in out.collect()} == {
        ("p", ".gitignore"), ("p", "w/.gitignore"), ("p", "w/a.gen"), ("p", "x"), ("q", "a.gen"), ("q", ".gitignore"), (None, "a.gen"), ("p", None),
    }
    nothing = spark.createDataFrame([], SCHEMA)
    assert ignore.without_ignored(nothing).count() == 0 and ignore.ignore_rules(nothing).count() == 0
