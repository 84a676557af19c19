"""A model for tests: sixes for every segment that a prompt names, sevens for a course."""

import json

from tessella.functions import values as V


def answer(prompt):
    if "SEGMENT ID" in prompt:
        if "Aim" not in prompt:
            raise ValueError("the rubrics are missing")
        ids = [int(x.split(" ")[0]) for x in prompt.split("SEGMENT ID: ")[1:]]
        return json.dumps({"evaluations": [{"segment_id": i, "scores": dict.fromkeys(V.MODULE_DIMS, 6), "reasoning": {}, "summary": f"What {i} covers"} for i in ids]})
    if "Whole" not in prompt:
        raise ValueError("the rubrics are missing")
    return json.dumps({"submit_course_evaluation": {"scores": dict.fromkeys(V.COURSE_DIMS, 7), "reasoning": {}}})
