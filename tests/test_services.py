import datetime as dt
import io
import json
from pathlib import Path

import pytest

from prismetric import cli, config, narrate, rpc, voices
from prismetric.model import NameRule, TableProfile
from prismetric.plans import adhoc
from prismetric.streaming import watch


@pytest.fixture
def tiny(tmp_path):
    p = tmp_path / "tiny.csv"
    p.write_text("id,grp,v\n1,a,10\n2,a,20\n3,b,30\n")
    return p


def run(capsys, *args):
    code = cli.main(["--no-config", *map(str, args)])
    return code, capsys.readouterr().out


def test_sql(spark, tiny):
    s = adhoc.open_session(spark, tiny)
    assert (s.columns, s.row_count) == ((("id", "BIGINT"), ("grp", "VARCHAR"), ("v", "BIGINT")), 3)
    assert s.run_sql("SELECT grp, sum(v) AS s FROM data GROUP BY ALL ORDER BY ALL;") == (["grp", "s"], [("a", 30), ("b", 30)])
    assert s.run_sql("  ; ") == ([], [])
    assert s.run_sql("SELECT * EXCLUDE (id) FROM data ORDER BY id") == (["grp", "v"], [("a", 10), ("a", 20), ("b", 30)])
    assert s.run_sql("SELECT id FROM data QUALIFY row_number() OVER (PARTITION BY grp ORDER BY v DESC) = 1 ORDER BY id")[1] == [(2,), (3,)]
    assert s.run_sql("SELECT list_contains([1, 2], 2) AS x, '[a] EXCLUDE' AS y")[1] == [(True, "[a] EXCLUDE")]
    assert s.run_sql('SELECT "grp" FROM data LIMIT 1')[1] == [("a",)]
    assert [r[0] for r in s.run_sql("SUMMARIZE data")[1]] == ["id", "grp", "v"]
    assert len(s.sample(2)[1]) == 2
    with pytest.raises(adhoc.DialectError):
        s.run_sql("SELECT * FROM data ASOF JOIN data USING (id)")


def test_limits():
    assert adhoc.limited("SELECT 1", 5) == "SELECT 1 LIMIT 5"
    assert adhoc.limited("SELECT 1\nLIMIT 2", 5) == "SELECT 1\nLIMIT 2"
    assert adhoc.limited("SELECT ' LIMIT '", 5).endswith("LIMIT 5")
    assert adhoc.limited("DESCRIBE data", 5) == "DESCRIBE data"
    assert adhoc.limited("SELECT * FROM (SELECT 1 LIMIT 2)", 5).endswith(") LIMIT 5")


def test_sql_means_the_same(spark, tiny):
    s = adhoc.open_session(spark, tiny)
    assert s.run_sql("SELECT string_split('a.b|c', '.') AS a, string_split('a|b', '|')[1] AS b, string_split('x', '\\\\E') AS c")[1] == [(["a", "b|c"], "a", ["x"])]
    assert s.run_sql("SELECT [10, 20, 30][1] AS a, [10, 20][-1] AS b, [1][2] AS c, [[1, 2], [3]][1][2] AS d, map('k', 5)['k'] AS e")[1] == [(10, 20, None, 2, 5)]
    assert s.run_sql("SELECT strptime('05/01/2024 07', '%d/%m/%Y %H') AS t, strftime(TIMESTAMP_NTZ'2024-02-03 04:05:06', '%Y week %m') AS f")[1] == [(dt.datetime(2024, 1, 5, 7), "2024 week 02")]
    for sql in ("SELECT strptime('x', '%Q')", "SELECT strptime('x', grp) FROM data", "SELECT [1, 2, 3][1:2]", "SELECT * FROM (SELECT 1 AS a UNION BY NAME SELECT 2 AS a)"):
        with pytest.raises(adhoc.DialectError):
            s.run_sql(sql)
    names, rows = s.run_sql("SELECT 1 AS a, 2 AS b UNION BY NAME SELECT 2 AS b, 1 AS a UNION BY NAME SELECT 3 AS c")
    assert (names, sorted(rows, key=str)) == (["a", "b", "c"], [(1, 2, None), (None, None, 3)])
    assert len(s.run_sql("SELECT * FROM data USING SAMPLE 2 ROWS")[1]) == 2
    assert len(s.run_sql("SELECT a.id FROM range(300) a JOIN (SELECT 1 AS x LIMIT 1)")[1]) == 200


def test_debounce():
    e = lambda at, *names: watch.WatchEvent(tuple(map(Path, names)), at)
    got = list(watch.debounced([e(0, "a"), e(0.1, "b"), e(0.2, "a"), e(1.0, "c"), e(1.1, "d")], 500))
    assert [[p.name for p in x.paths] for x in got] == [["a"], ["b", "a", "c"], ["d"]]
    with pytest.raises(ValueError):
        list(watch.debounced([], -1))


def test_polling_tells_what_is_gone(tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("1"), b.write_text("1")
    steps = iter([lambda: a.unlink(), lambda: None, lambda: a.write_text("2"), lambda: b.unlink()])
    events = list(watch.polled(lambda: [a, *tmp_path.glob("b*")], 0, sleep=lambda _: next(steps)(), rounds=4))
    assert [e.paths for e in events] == [(a,), (a,), (b,)]


def test_polling(tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("1")
    states = iter(["1", "12", "12"])
    events = list(watch.polled(lambda: [p], 0, sleep=lambda _: p.write_text(next(states)) if True else None, rounds=3))
    assert any(e.paths == (p,) for e in events)
    assert watch.targets([str(tmp_path), str(tmp_path / "*.csv"), str(p)]) == [p]


def test_watch_counts_errors():
    seen = []

    def render(p):
        if p.name == "bad":
            raise ValueError("x")
        seen.append(p.name)

    stats = watch.watch([watch.WatchEvent((Path("a"), Path("bad")), 0)], render, [Path("first")], lambda p, e: seen.append(f"!{p.name}"))
    assert (seen, stats.renders, stats.events, stats.errors) == (["first", "a", "!bad"], 2, 1, 1)

    def stop(p):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        watch.watch([], stop, [Path("x")])


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.range(5).write.parquet(str(src))
    got = {}
    q = watch.stream_profiles(spark, str(src), "id long", lambda n, r: got.update({n: r.rows})).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert got == {0: 5}


def test_config(tmp_path):
    (tmp_path / "home" / "prismetric").mkdir(parents=True)
    (tmp_path / "home" / "prismetric" / "config.toml").write_text('persona = "noir"\n[pii]\nname_rules = [{pattern = "a*", detector = "X"}]\n')
    (tmp_path / "pyproject.toml").write_text('[tool.prismetric]\nsample = 5\npersona = "pirate"\n')
    inner = tmp_path / "sub"
    inner.mkdir()
    (inner / ".prismetric.toml").write_text('fail-on-pii = "HIGH"\n[watch]\ndebounce-ms = 10\n[pii]\nname_rules = [{pattern = "b*", detector = "y", confidence = "low"}]\n')
    got = config.load(start=inner, env={"XDG_CONFIG_HOME": str(tmp_path / "home")})
    assert got.values["persona"] == "pirate" and got.values["sample"] == 5 and got.values["fail_on_pii"] == "high" and got.values["watch"] == {"debounce_ms": 10}
    assert got.values["pii"]["name_rules"] == [NameRule("a*", "x", "medium"), NameRule("b*", "y", "low")]
    assert len(got.sources_by_path) == 3
    assert config.load(disable=True).values == {}
    with pytest.raises(config.ConfigNotFoundError):
        config.load(tmp_path / "none.toml")


@pytest.mark.parametrize("text", ["sample = 0", 'sample = "x"', "min_score = 101", "no_timeseries = 1", "[llm]\napi_key = 'x'", "[watch]\npoll_interval = 0", "[render]\ncolor = 'red'", "llm = 1", "x = [", '[pii]\nname_rules = [{pattern = ""}]'])
def test_bad_config(tmp_path, text):
    p = tmp_path / "c.toml"
    p.write_text(text)
    with pytest.raises(config.ConfigError):
        config.load(p)


def test_unknown_top_key_warns(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text("colour = 1")
    with pytest.warns(UserWarning, match="colour"):
        assert config.load(p).values == {}


REPORT = TableProfile(0)
CONF = narrate.LLMConfig("http://x.test/v1/", "k", "gpt-4o-mini-2024")


def test_narrate():
    sent = {}

    def send(conf, body):
        sent.update(body, url=conf.endpoint)
        return {"choices": [{"message": {"content": [{"text": " a"}, {"text": "b "}]}}], "usage": {"prompt_tokens": 1000, "completion_tokens": 1000, "total_tokens": 2000}}

    got = narrate.read(REPORT, CONF, voices.resolve("noir"), send)
    assert (got.text, got.cost_usd, sent["temperature"], sent["url"]) == ("ab", 0.00075, 0.6, "http://x.test/v1/chat/completions")
    for bad in ({}, {"choices": []}, {"choices": [{"message": {"content": " "}}]}):
        with pytest.raises(narrate.LLMUnavailableError):
            narrate.read(REPORT, CONF, send=lambda *_, bad=bad: bad)


def test_narrate_settings():
    with pytest.raises(narrate.LLMUnavailableError, match=narrate.BASE_URL):
        narrate.load_config({})
    got = narrate.load_config({narrate.BASE_URL: "http://a", narrate.KEY: "s"}, base_url="http://b", model="m")
    assert (got.base_url, got.model, got.api_key, got.timeout) == ("http://a", "m", "s", 30.0)
    assert narrate.cost("local", 1, 1) is None


def test_rpc(spark, tiny):
    ask = lambda method, params=None, number=1: rpc.handle({"jsonrpc": "2.0", "id": number, "method": method, "params": params or {}}, lambda: spark)
    assert ask("initialize", {"protocolVersion": "x"})["result"]["protocolVersion"] == "x"
    assert ask("ping")["result"] == {} and [t["name"] for t in ask("tools/list")["result"]["tools"]] == ["summon", "read"]
    done = ask("tools/call", {"name": "summon", "arguments": {"path": str(tiny), "sample": 2}})["result"]
    assert done["isError"] is False and json.loads(done["content"][0]["text"])["profile"]["rows"] == 2
    for args in ({}, {"path": "none.csv"}, {"path": str(tiny), "sample": 0}, {"path": str(tiny), "fail_on_pii": "x"}):
        assert ask("tools/call", {"name": "summon", "arguments": args})["result"]["isError"] is True
    assert ask("tools/call", {"name": "none"})["error"]["code"] == rpc.NO_METHOD
    assert ask("none")["error"]["code"] == rpc.NO_METHOD and rpc.handle([])["error"]["code"] == rpc.INVALID
    assert rpc.handle({"method": "notifications/initialized"}) is None


def test_rpc_loop():
    body = json.dumps({"jsonrpc": "2.0", "id": 2, "method": "ping"})
    out = io.StringIO()
    rpc.serve(io.StringIO('\n{"jsonrpc": "2.0", "id": 1, "method": "ping"}\n' + f"Content-Length: {len(body)}\r\n\r\n{body}\nnot json\n"), out)
    answers = [json.loads(line) for line in out.getvalue().splitlines()]
    assert [a.get("id") for a in answers] == [1, 2, None] and answers[2]["error"]["code"] == rpc.PARSE


def test_summon(spark, capsys, people, tmp_path):
    code, out = run(capsys, "summon", people, "--json", "--score", "--fail-on-pii", "high", "--html", tmp_path / "r.html", "--badge", tmp_path / "b.svg")
    data = json.loads(out)
    assert code == cli.PII and data["rows"] == 3 and "score" in data and (tmp_path / "r.html").exists() and (tmp_path / "b.svg").exists()
    assert run(capsys, "summon", people, "--quiet", "--min-score", "100")[0] == cli.LOW_SCORE
    code, out = run(capsys, "summon", people, "--score-only")
    assert code == 0 and out.strip().isdigit()
    assert run(capsys, "summon", people, "--expectations", "gx", "--json")[0] == cli.BAD_INPUT
    assert run(capsys, "summon", tmp_path / "none.csv")[0] == cli.BAD_INPUT
    assert run(capsys, "summon", people, "--sample", "0")[0] == 2


def test_summon_many(spark, capsys, tmp_path, people):
    code, out = run(capsys, "summon", people.parent, "--json", "--include", "*.csv")
    assert code == 0 and json.loads(out)["summary"]["files_loaded"] == 1
    assert run(capsys, "summon", people.parent, "--quiet", "--fail-on-pii", "high")[0] == cli.PII


def test_compare(spark, capsys, people, tiny):
    code, out = run(capsys, "compare", tiny, people, "--json", "--fail-on", "high")
    assert code == cli.DIFFERS and json.loads(out)["severity"] == "high"
    assert run(capsys, "compare", tiny, tiny, "--fail-on", "low")[0] == 0


def test_redact(spark, capsys, people, tmp_path):
    code, out = run(capsys, "redact", people, "--dry-run", "--json", "--strategy", "email=null")
    assert code == 0 and {a["column"]: a["strategy"] for a in json.loads(out)["actions"]}["email"] == "null"
    code, out = run(capsys, "redact", people, "-o", tmp_path / "o.csv", "--json")
    assert json.loads(out)["total_cells_redacted"] == 18
    assert run(capsys, "redact", people)[0] == cli.BAD_INPUT


def test_other_commands(spark, capsys, tiny, monkeypatch):
    assert "30" in run(capsys, "parlor", tiny, "--sql", "SELECT max(v) FROM data")[1]
    assert run(capsys, "parlor", tiny, "--sql", "SELEC")[0] == cli.BAD_INPUT
    assert "noir" in run(capsys, "personas")[1]
    assert run(capsys, "config", "--json")[0] == 0
    monkeypatch.delenv(narrate.BASE_URL, raising=False)
    assert run(capsys, "read", tiny, "--no-show-profile")[0] == cli.NO_READING
    assert cli.main(["--no-config", "--persona", "nobody"]) == cli.BAD_INPUT
