"""Salience of candidates, the scores of what could be done about them, and the leaky units that choose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# -- fixed values: threshold and leak of each unit; words that speak for two of the actions; weights of the salience
SALIENCE = {"novelty": (0.72, 0.78), "conflict": (0.68, 0.84), "risk": (0.70, 0.86), "value": (0.75, 0.82), "urgency": (0.66, 0.80), "fatigue": (0.80, 0.88)}
ACTIONS = {
    "fine_inspect": (0.80, 0.76), "coarse_scan": (0.72, 0.74), "backtrack": (0.78, 0.82), "summarize": (0.76, 0.78), "test_code": (0.76, 0.80), "write_memory": (0.74, 0.80), "delegate_agent": (0.82, 0.78), "drop_path": (0.76, 0.86),
}
CODE_WORDS = ["python", "def ", "class ", "json", "api", "bug", "测试", "代码", "程序"]
AGENT_WORDS = ["agent", "智能体", "多视角", "llm", "角色", "分派"]
WEIGHTS = {"value": 1.15, "conflict": 1.05, "risk": 1.00, "novelty": 0.90, "urgency": 0.80, "fatigue": -0.55}


def _unit(x: Column) -> Column:
    # a hair more, so that what lies on a half in decimals rounds up whatever its binary form
    return F.round(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) + 1e-9, 4)


def action_scores(signals: DataFrame) -> DataFrame:
    """Rows with the six signals and ``text``, with the salience and the score of each action."""
    low = F.lower(F.coalesce("text", F.lit("")))
    hits = lambda ws: sum(((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w) for w in ws), F.lit(0.0))
    s = {n: F.col(n) for n in SALIENCE}
    rows = signals.withColumn("salience", _unit(sum((F.col(n) * w for n, w in WEIGHTS.items()), F.lit(0.0)) / 3.1))
    top = F.col("salience")
    scores = {
        "fine_inspect": 0.42 * top + 0.25 * s["conflict"] + 0.20 * s["risk"] + 0.16 * s["value"],
        "coarse_scan": 0.26 + 0.23 * s["novelty"] + 0.10 * (1.0 - top),
        "backtrack": 0.18 + 0.35 * s["conflict"] + 0.20 * s["fatigue"],
        "summarize": 0.20 + 0.25 * s["value"] + 0.18 * s["urgency"],
        "test_code": 0.12 + F.least(hits(CODE_WORDS), F.lit(6.0)) / 12.0 + 0.15 * s["risk"],
        "write_memory": 0.16 + 0.22 * s["value"] + 0.22 * s["novelty"] + 0.10 * s["urgency"],
        "delegate_agent": 0.08 + F.least(hits(AGENT_WORDS), F.lit(5.0)) / 10.0 + 0.22 * s["novelty"],
        "drop_path": 0.10 + 0.45 * s["fatigue"] - 0.18 * s["urgency"] - 0.18 * s["risk"],
    }
    return rows.select("*", *[_unit(v).alias(n) for n, v in scores.items()])


def controlled(scored: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The candidates of each key in order through two populations of leaky units: v = v * leak + current, back to 0 on firing.

    Comes out: key, order, salience, the salience units that fired, mode, the action (of the fired ones the best, else the best), the actions that fired. The state is one number a unit, so a key's candidates pass in one
    sorted stream of batches, however many there are; keys run beside each other.
    """
    import numpy as np
    import pandas as pd

    signals, actions = list(SALIENCE), list(ACTIONS)
    theta, leak = np.array([*SALIENCE.values(), *ACTIONS.values()]).T
    need = [signals.index(x) for x in ("conflict", "risk", "value")]

    def run(batches):
        now, v = None, np.zeros(len(theta))
        for pdf in batches:
            currents, out = pdf[[*signals, *actions]].to_numpy(float), []
            for i, (k, sure) in enumerate(zip(pdf[key], pdf["salience"])):
                if i == 0 and now is None or k != now:
                    now, v = k, np.zeros(len(theta))
                v = v * leak + currents[i]
                fired = v >= theta
                v = np.where(fired, 0.0, v)
                own, score = fired[len(signals) :], currents[i, len(signals) :]
                best = int(np.where(own, score, -1.0).argmax()) if own.any() else int(score.argmax())
                out.append((*(pdf[c].iloc[i] for c in (key, *order)), sure, [n for n, f in zip(signals, fired) if f], "fine" if sure >= 0.46 or fired[need].any() else "coarse", actions[best], [n for n, f in zip(actions, own) if f]))
            yield pd.DataFrame(out, columns=[key, *order, "salience", "salient", "mode", "action", "fired"])

    kinds = ", ".join(f"{c} {scored.schema[c].dataType.simpleString()}" for c in (key, *order))
    rows = scored.select(key, *order, "salience", *signals, *actions).repartition(key).sortWithinPartitions(key, *order)
    return rows.mapInPandas(run, f"{kinds}, salience double, salient array<string>, mode string, action string, fired array<string>")
