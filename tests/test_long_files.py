"""Directives of a long file: what each covers, and that its lines are not read anew for each line."""

import time

from graphloom.operators import ignores


def test_directives_of_a_long_file(spark):
    lines, want = [], set()
    for i in range(50_000):
        if i % 500 == 0:
            lines += ["// graphloom-ignore unfinished: later", "", "// more", "@mark"]
            want.add((len(lines) - 3, len(lines) + 1))
        lines += [f"function f{i}() {{", f"  return {i};", "}"]
    lines += ["// graphloom-ignore unfinished: nothing follows", "// end"]
    want.add((len(lines) - 1, None))
    files = spark.createDataFrame([("a.ts", "\n".join(lines))], "file string, content string")
    begun = time.time()
    got = {(r.line, r.target) for r in ignores.directives(files).collect()}
    assert time.time() - begun < 30
    assert got == want


def test_what_directives_of_a_long_file_leave(spark):
    lines, found, want = [], [], set()
    for i in range(50_000):
        if i % 1000 == 0:
            lines.append("// graphloom-ignore unfinished: later" if i % 2000 else "// graphloom-ignore unfinished")
        if i % 500 == 0:
            found.append(("a.ts", len(lines) + 1, "unfinished"))
            want |= {len(lines) + 1} if i % 2000 != 1000 else set()
        lines += [f"function f{i}() {{", "  throw new Error('not implemented');", "}"]
    files = spark.createDataFrame([("a.ts", "\n".join(lines))], "file string, content string")
    begun = time.time()
    left, _ = ignores.apply(spark.createDataFrame(found, "file string, line int, kind string"), ignores.directives(files))
    assert {r.line for r in left.collect()} == want
    assert time.time() - begun < 30
