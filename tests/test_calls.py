"""Calls that a rerun takes up again."""

import os
import uuid
from collections import Counter

from lumenreel.sources.calls import ask_logged


def service(folder, down):
    """A caller that leaves a file for each call, and fails on some prompts while the file `down` is there."""

    def call(prompt):
        open(f"{folder}/{prompt.replace(' ', '_')}.{uuid.uuid4().hex}", "w").close()
        if os.path.exists(down) and prompt.endswith(("3", "7")):
            raise TimeoutError("no answer")
        return prompt.upper()

    return call


def calls(folder):
    return Counter(f.split(".")[0] for f in os.listdir(folder))


def test_a_rerun_asks_only_for_what_is_missing(spark, tmp_path):
    seen, down, log = f"{tmp_path}/calls", f"{tmp_path}/down", f"file://{tmp_path}/log"
    os.mkdir(seen)
    open(down, "w").close()
    rows = [(i, f"prompt {i % 10}", "old") for i in range(25)] + [(98, None, "old"), (99, "", "old")]
    prompts = spark.createDataFrame(rows, "batch long, prompt string, answer string").repartition(3)
    ask = lambda: {r["batch"]: (r["answer"], r["error"]) for r in ask_logged(prompts, service(seen, down), log, lanes=2, slices=2, tries=2, pause=0.0).collect()}
    first = ask()
    assert len(first) == 27 and first[4] == ("PROMPT 4", None) and first[3] == first[13] == (None, "TimeoutError: no answer")
    assert first[98] == (None, None) and first[99] == ("", None)
    assert calls(seen) == {f"prompt_{i}": 2 if i in (3, 7) else 1 for i in range(10)} | {"": 1}  # equal prompts once, failures twice
    os.remove(down)
    second = ask()
    assert all(a is not None and e is None for k, (a, e) in second.items() if k != 98) and second[7] == ("PROMPT 7", None)
    assert calls(seen) == {f"prompt_{i}": 3 if i in (3, 7) else 1 for i in range(10)} | {"": 1}
    more = prompts.unionByName(spark.createDataFrame([(50, "prompt 50", None)], "batch long, prompt string, answer string"))
    third = ask_logged(more, service(seen, down), log, lanes=2, slices=2, pause=0.0).collect()
    assert len(third) == 28 and calls(seen)["prompt_50"] == 1 and sum(calls(seen).values()) == 16


def test_no_prompts(spark, tmp_path):
    none = spark.createDataFrame([], "batch long, prompt string")
    assert ask_logged(none, str.upper, f"file://{tmp_path}/log", slices=1).count() == 0
