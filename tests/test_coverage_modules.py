"""A line of a file that ran means that its module ran, and so what that imports."""

from graphloom.operators.dead import find_dead
from graphloom.plans.staging import Stage
from graphloom.sources import code

FILES = {
    "src/index.ts": "export function main() { return 1; }\nmain();\n",
    "src/plugin.ts": "import { helper } from './helper';\nexport function unused() {\n  return helper();\n}\nexport const ready = 1;\n",
    "src/helper.ts": "export function helper() {\n  return inner();\n}\nfunction inner() { return 2; }\nfunction gone() { return 3; }\n",
}


def test_executed_modules_are_roots(spark):
    stage = Stage(spark)
    g = code.build(spark.createDataFrame(list(FILES.items()), "file string, content string"), stage)

    def left(*lines):
        ran = spark.createDataFrame([("src/plugin.ts", n) for n in lines], "file string, line int")
        return {r.name: r.score for r in find_dead(g, stage, entry=("src/index.ts",), coverage=ran, rules=()).collect()}

    assert {k: v for k, v in left(1).items() if k in ("unused", "ready")} == {"unused": 0.97, "ready": 0.97}
    assert set(left(1)) == {"unused", "ready", "gone"}
    assert set(left(99)) == {"unused", "ready", "helper", "inner", "gone"}


def test_ambient_declarations_are_no_dead_code(spark):
    files = {"src/index.ts": "main();\n", "src/types.ts": "declare class Far {\n}\nexport declare function there(): void;\ndeclare const VERSION: string;\nclass Near {\n}\nexport function declared() { return 1; }\nconst declare = 1;\nfunction plain() { return 2; }\n"}
    stage = Stage(spark)
    g = code.build(spark.createDataFrame(list(files.items()), "file string, content string"), stage)
    assert {r.name for r in find_dead(g, stage, entry=("src/index.ts",), rules=()).collect()} == {"Near", "declared", "declare", "plain"}
