"""The payload contract against a model of it that is written down on its own, and what an accepted row loads as."""

import datetime as dt
import json
import random
import re

import pytest

from tickforge.operators import rejects

TODAY = dt.date(2030, 1, 1)
BASE = {"ticker": "QX", "trade_date": "2022-03-09", "open": 41.5, "high": 44.25, "low": 40.75, "close": 42.0, "adj_close": 39.5, "volume": 5100, "source": "feed", "event_ts": "2022-03-09T18:30:00+00:00"}


def judged(payloads):
    return rejects.judge_payloads(payloads, TODAY.toordinal() - 719163)


def model_verdict():
    pydantic = pytest.importorskip("pydantic")
    positive = pydantic.Field(gt=0)

    class Model(pydantic.BaseModel):
        model_config = pydantic.ConfigDict(extra="forbid", str_strip_whitespace=True)
        ticker: str
        trade_date: dt.date
        open: float = positive
        high: float = positive
        low: float = positive
        close: float = positive
        adj_close: float | None = pydantic.Field(default=None, gt=0)
        volume: int = pydantic.Field(ge=0)
        source: str = "x"
        event_ts: dt.datetime = dt.datetime(2000, 1, 1)

        @pydantic.field_validator("ticker")
        @classmethod
        def symbol(cls, v):
            v = v.strip().upper()
            if not re.fullmatch(rejects.SYMBOL.strip("^$"), v):
                raise ValueError("symbol")
            return v

        @pydantic.field_validator("trade_date")
        @classmethod
        def past(cls, v):
            if v > TODAY:
                raise ValueError("future")
            return v

    def verdict(raw):
        try:
            o = json.loads(raw)
        except ValueError:
            return "MALFORMED_JSON"
        if not isinstance(o, dict):
            return "WRONG_TYPE"
        try:
            m = Model.model_validate(o)
        except pydantic.ValidationError as e:
            err = e.errors(include_context=False, include_input=False, include_url=False)[0]
            field, kind = err["loc"][0] if err["loc"] else "", err["type"]
            if kind == "missing":
                return "MISSING_FIELD"
            if kind == "extra_forbidden":
                return "WRONG_TYPE"
            if field == "ticker":
                return "INVALID_TICKER"
            if field == "trade_date":
                return "FUTURE_DATED" if kind == "value_error" else "INVALID_TIMESTAMP"
            if field in ("open", "high", "low", "close", "adj_close"):
                return "NON_POSITIVE_PRICE" if kind == "greater_than" else "WRONG_TYPE"
            if field == "volume":
                return "NEGATIVE_VOLUME" if kind == "greater_than_equal" else "WRONG_TYPE"
            return "UNKNOWN"
        bad = m.high < m.low or m.high < max(m.open, m.close) or m.low > min(m.open, m.close)
        return "OHLC_INCONSISTENT" if bad else None

    return verdict


VALUES = [
    1, 0, -1, -0.0, 2.5, 3.0, 43.0, 1e400, -1e400, float("nan"), 10**17, 10**30, True, False, None, [], {}, [1], {"a": 1}, "", " ", "x", "1", " 42.0 ", "+41", "4_1.5", "41_", "4__1", "41.", ".5", "4.15e1", "5._0", "inf",
    "NaN", "N/A", "41,5", "QX", " qx ", "brk.b", "BF-BB", "TOOLONGX", "ß", "ﬁ", "ﬀ", "aé", "QX\n", " QX", "\ud800", "2022-03-09", "2022-3-9", "2022-02-30", "2031-01-01", "0000-01-01", "2022-03-09T00:00", "2022-03-09 00:00:00.000",
    "2022-03-09T00:00:00Z", "2022-03-09T00:00:00+02:00", "2022-03-09T24:00:00", "2022-03-09T18:30:15.1234567891", "2022-03-09T18:30:15,5-0330", "2022-03-09T18:30+24:00", "2022-03-09t18:30z", 1646784000, 1646784001, 1646784000000, "1646784000", "5.0e0", " 5",
    1.6467840005e9, 1e-7, 3e11, -62135596801, 99999999999999,
]


def test_every_field_with_every_value():
    verdict = model_verdict()
    cases = [json.dumps(BASE | {f: v}) for f in BASE for v in VALUES]
    cases += [json.dumps({k: v for k, v in BASE.items() if k != f}) for f in BASE] + [json.dumps(BASE | {k: 1}) for k in ("note", "", "\ud800", "Ticker")]
    cases += ["", "{", "[]", "null", "3", '"a"', json.dumps(BASE) + "}", json.dumps(BASE)[:-1], " " + json.dumps(BASE, indent=1), json.dumps(BASE).replace(",", ",,"), json.dumps(BASE).replace('"open"', '"open" ')]
    cases += [json.dumps(dict(reversed(BASE.items()))), '{"open":"x",' + json.dumps(BASE)[1:], json.dumps(BASE).replace("41.5", "041.5"), json.dumps(BASE).replace("41.5", "41.5e0"), json.dumps(BASE | {"source": "a,b\"c\\"})]
    got, _ = judged(cases)
    assert [(c, g, w) for c, g in zip(cases, got) if g != (w := verdict(c))] == []


def test_random_payloads():
    verdict, rng = model_verdict(), random.Random(8)
    cases = []
    for _ in range(1500):
        o = BASE | {rng.choice(list(BASE)): rng.choice(VALUES) for _ in range(rng.choice([0, 1, 1, 2]))}
        s = json.dumps(o, separators=rng.choice([(",", ":"), (", ", ": "), (" , ", " : ")]))
        if rng.random() < 0.2:
            k = rng.randrange(len(s))
            s = s[:k] + rng.choice(["", '"', ",", "}", "\\", "\n", "x"]) + s[k + rng.choice([0, 1]) :]
        cases.append(s)
    got, _ = judged(cases)
    assert [(c, g, w) for c, g in zip(cases, got) if g != (w := verdict(c))] == []


def test_accepted_values_load_as_they_stand():
    rows = [{"volume": 2**53 + 1}, {"volume": 2**63 - 1}, {"volume": 2**63}, {"volume": "9007199254740993"}, {"source": "a\u0000b"}, {"event_ts": 1646850600}, {"event_ts": "2022-03-09T18:30:00-02:00"}, {"volume": True}, {"open": 1e-5, "low": 1e-5}, {"volume": 10.0}]
    reason, typed = judged([json.dumps(BASE | r) for r in rows])
    assert reason == [None] * len(rows)
    assert typed["volume"].to_pylist()[:4] == [2**53 + 1, 2**63 - 1, None, 2**53 + 1] and typed["volume"].to_pylist()[7:] == [1, 5100, 10]
    assert typed["source"][4].as_py() == "a\u0000b" and typed["open"][8].as_py() == 1e-5
    assert typed["event_ts"].to_pylist()[5:7] == [dt.datetime(2022, 3, 9, 18, 30), dt.datetime(2022, 3, 9, 20, 30)]


def test_lines_that_run_on_into_others():
    rng = random.Random(9)
    lines, want = [], []
    for k in range(400):
        kind = rng.choice(["good", "good", "quoted", "open", "short", "long", "inner"])
        lines.append({"good": f"n{k},1", "quoted": f'"n,{k}",1', "open": f'n{k},"1', "short": f"n{k}", "long": f"n{k},1,2", "inner": f'n"{k},1'}[kind])
        want.append({"open": "BROKEN_QUOTING", "short": "COLUMN_COUNT", "long": "COLUMN_COUNT"}.get(kind))
    reason, where, fields = rejects._split_lines(lines, ["a", "b"], ",")
    assert reason == want and sorted(where.tolist()) == [k for k, w in enumerate(want) if w is None]
    assert {k: fields["b"][i].as_py() for i, k in enumerate(where.tolist())} == {k: "1" for k, w in enumerate(want) if w is None}
    assert rejects._split_lines(['x,"1'] * 9, ["a", "b"], ",")[0] == ["BROKEN_QUOTING"] * 9
