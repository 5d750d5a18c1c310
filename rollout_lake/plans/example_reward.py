"""A user reward function as a file, loaded by path and name in the registry queries."""


def reward(data_source, solution_str, ground_truth, extra_info):
    if extra_info % 9 == 0:
        raise ValueError("not gradable")
    return {"score": "boxed" in solution_str, "extra_info": {"length": len(solution_str)}}
