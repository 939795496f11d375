"""Readers and writers on small hand-made files."""

import json

from pyspark.sql import functions as F

from activity_engine.sources import readers as R
from activity_engine.sources import sinks as W


def put(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def test_logs(spark, tmp_path):
    put(tmp_path / "logon.csv", "id,date,user,pc,activity", "{A},01/04/2010 07:30:00,U1,PC-1,Logon")
    put(tmp_path / "device.csv", "id,date,user,pc,content,activity", "{B},01/04/2010 07:31:00,U1,PC-1,R:\\;R:\\x,Connect")
    put(tmp_path / "http.csv", "id,date,user,pc,url,activity,content", '{C},01/04/2010 07:32:00,U1,PC-1,http://a.b/c,WWW Visit,"one, two, three"')
    put(tmp_path / "email.csv", "id,date,user,pc,to,cc,bcc,from,activity,size,att,content", '{D},01/04/2010 07:33:00,U1,PC-1,a@dtaa.com;b@x.com,,,U1@dtaa.com,Send,10,f.doc(3),"hi"')
    put(tmp_path / "file.csv", "id,date,user,pc,filename,activity,to,from,content", '{E},bad date,U1,PC-1,C:\\a.doc,File Open,False,True,"x"')
    rows = {r["type"]: r for r in R.read_activity(spark, str(tmp_path), "r6.2").collect()}
    assert set(rows) == {"logon", "device", "http", "email", "file"}
    assert rows["http"]["content"] == "one, two, three" and rows["http"]["to"] is None and rows["email"]["size"] == 10
    assert str(rows["logon"]["ts"]) == "2010-01-04 07:30:00" and rows["file"]["ts"] is None and rows["device"]["content"] == "R:\\;R:\\x"


def test_dimensions(spark, tmp_path):
    head = "employee_name,user_id,email,role,business_unit,functional_unit,department,team,supervisor"
    put(tmp_path / "LDAP/2009-12.csv", head, "Ann A,U1,a@dtaa.com,ITAdmin,1,2,3,4,Bob B")
    put(tmp_path / "LDAP/2010-01.csv", head, "Bob B,U2,b@dtaa.com,Boss,1,2,3,4,")
    assert {(r["user_id"], r["month"], r["supervisor"]) for r in R.read_employees(spark, str(tmp_path / "LDAP"), "r4.2").collect()} == {("U1", "2009-12", "Bob B"), ("U2", "2010-01", None)}
    put(tmp_path / "psy.csv", "employee_name,user_id,O,C,E,A,N", "Ann A,U1,1,2,3,4,5")
    assert R.read_psychometric(spark, str(tmp_path / "psy.csv")).first()["N"] == 5 and R.read_psychometric(spark, None).count() == 0


def test_answers(spark, tmp_path):
    put(tmp_path / "insiders.csv", "dataset,scenario,details,user,start,end", "6.2,4,a.csv,U1,/05/2010 01:00:00,02/09/2010 01:00:00", "4.2,1,b.csv,U2,01/05/2010 01:00:00,02/09/2010 01:00:00")
    r = R.read_insiders(spark, str(tmp_path / "insiders.csv"), "r6.2").collect()
    assert [(x["user"], x["scenario"], str(x["mstart"])) for x in r] == [("U1", 4, "2010-02-05 01:00:00")]
    assert [x["user"] for x in R.read_insiders(spark, str(tmp_path / "insiders.csv"), "r4.2").collect()] == ["U2"]
    put(tmp_path / "answers/r4.2-1/b.csv", 'logon,{X1},01/05/2010 01:00:00,U2,PC-1,"a, b"', "http,{X2},01/05/2010 01:00:00,U2", "short")
    assert {(x["user"], x["actid"], x["details"]) for x in R.read_answers(spark, str(tmp_path / "answers")).collect()} == {("U2", "{X1}", "b.csv"), ("U2", "{X2}", "b.csv")}


def test_results(spark, tmp_path):
    put(tmp_path / "r/round_2_results.csv", "user,max_z_score,is_actual_insider", "1,2.5,1")
    put(tmp_path / "r/round_10_results.csv", "user,max_z_score,is_actual_insider", "1,3.5,0")
    assert {(x["round"], x["max_z_score"]) for x in R.read_rounds(spark, str(tmp_path / "r")).collect()} == {(2, 2.5), (10, 3.5)}
    put(tmp_path / "log.csv", "upload,1.5", "upload,2.5")
    assert R.read_communication(spark, str(tmp_path / "log.csv")).agg(F.sum("mb")).first()[0] == 4
    put(tmp_path / "e/a/experiment_summary.json", json.dumps({"experiment_name": "a", "best_metrics": {"pr_auc": 0.5}}, indent=1))
    put(tmp_path / "e/b/experiment_summary.json", "{ broken")
    assert [x["experiment_name"] for x in R.read_summaries(spark, f"{tmp_path}/e/*/experiment_summary.json").collect()] == ["a"]


def test_sinks(spark, tmp_path):
    df = spark.range(10).select("id", (F.col("id") % 3).cast("int").alias("week"), F.lit(1).alias("round"))
    for _ in range(2):
        W.write_by_week(df, f"{tmp_path}/w")
    assert spark.read.parquet(f"{tmp_path}/w").filter("week = 1").count() == 3
    path = W.write_representation(df, str(tmp_path), "day", "percentile", 30)
    assert path.endswith("day-percentile30") and R.read_features(spark, path).count() == 10
    W.write_csv(df, f"{tmp_path}/c")
    assert R.read_features(spark, f"{tmp_path}/c", "csv").count() == 10
    W.write_summary(spark.createDataFrame([("a", (0.5,))], "experiment_name string, best_metrics struct<pr_auc: double>"), f"{tmp_path}/s")
    assert R.read_summaries(spark, f"{tmp_path}/s").first()["best_metrics"]["pr_auc"] == 0.5
    W.write_rounds(df, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").filter("round = 1").count() == 10


def test_answers_of_the_index(spark, tmp_path):
    """Only the files that the version's index names count, each for its own user."""
    line = lambda i, u: f"logon,{{{i}}},01/05/2010 01:00:00,{u},PC-1"
    put(tmp_path / "a/r4.2-1/b.csv", line("X1", "U2"), line("X2", "U9"))
    put(tmp_path / "a/r5.2-1/b.csv", line("X3", "U2"))
    put(tmp_path / "a/c.csv", line("X4", "U2"))
    index = spark.createDataFrame([(1, "b.csv", "U2")], "scenario int, details string, user string")
    got = lambda i, v: {(r["user"], r["actid"]) for r in R.read_index_answers(spark, str(tmp_path / "a"), i, v).collect()}
    assert got(index, "r4.2") == {("U2", "{X1}")} and got(index, "r5.2") == {("U2", "{X3}")} and got(index.limit(0), "r4.2") == set()
    assert got(spark.createDataFrame([(3, "c.csv", "U2")], index.schema), "r6.2") == {("U2", "{X4}")}


def words(text):
    return text.count(" ") + 1


def literal_action(version, row):
    """The features of one raw row, told for that row alone."""
    new, kind, out = version[1] in "56", row["type"], {}
    text = row.get("content") or ""
    types = {"zip": 2, "rar": 2, "7z": 2, "jpg": 3, "png": 3, "bmp": 3, "doc": 4, "docx": 4, "pdf": 4, "txt": 5, "cfg": 5, "rtf": 5, "exe": 6, "sh": 6}
    if kind == "file":
        path = row["filename"]
        out = {"file_type": types.get(path.split(".")[1], 1), "file_len": len(text), "file_nwords": words(text), "disk": {"C": 1, "R": 2}.get(path[0], 0), "file_depth": path.count("\\")}
        if new:
            out |= {"file_act": ["file open", "file copy", "file write", "file delete"].index(row["activity"].lower()) + 1, "to_usb": int(row["to"] == "True"), "from_usb": int(row["from"] == "True")}
    elif kind == "http":
        out = {"http_type": row["_site"], "url_len": len(row["url"]), "url_depth": row["url"].count("/") - 2, "http_c_len": len(text), "http_c_nwords": words(text)}
        if version[1] == "6":
            out["http_act"] = ["www visit", "www download", "www upload"].index(row["activity"].lower()) + 1
    elif kind == "email":
        to, cc, bcc = (x.split(";") if x else [] for x in (row["to"], row["cc"], row["bcc"]))
        far = [a for a in to + cc + bcc if "dtaa.com" not in a]
        out = {"n_des": len(to + cc + bcc), "Xemail": int(bool(far)), "n_exdes": len(far), "n_bccdes": len(bcc), "exbccmail": int(any("dtaa.com" not in a for a in bcc)), "email_size": row["size"], "email_text_slen": len(text), "email_text_nwords": words(text)}
        if new:
            atts = [a for a in row["att"].split(";")]
            out |= {"n_atts": len(atts), "send_mail": int(row["activity"] == "Send"), "receive_mail": int(row["activity"] in ("Receive", "View"))}
            for name, code in zip(("other", "comp", "pho", "doc", "txt", "exe"), range(1, 7), strict=True):
                own = [a for a in atts if types.get(a.split(".")[1].split("(")[0], 1) == code]
                out |= {f"e_att_{name}": len(own), f"e_att_s{name}": sum(int(a.split("(")[1][:-1]) for a in own)}
        else:
            out["n_atts"] = row["n_att"]
    elif kind == "device" and new and row["activity"] == "Connect":
        out = {"file_tree_len": len(text.split(";"))}
    return out


def test_raw_logs_to_actions(spark, tmp_path):
    """Files of each version, read and made numeric, against each row told alone."""
    import csv

    from activity_engine.operators.features import day_features
    from activity_engine.operators.raw import numeric_actions
    from activity_engine.schemas import log_schema

    for version in ("r4.2", "r5.2", "r6.2"):
        new = version[1] in "56"
        rows = [
            {"type": "logon", "id": "{L1}", "date": "01/04/2010 07:29:59", "user": "U1", "pc": "PC-1", "activity": "Logon", "_act": 1, "_time": 2, "_pc": 0},
            {"type": "device", "id": "{D1}", "date": "01/04/2010 08:00:00", "user": "U1", "pc": "PC-2", "activity": "Connect", "content": "R:\\;R:\\x;R:\\y", "_act": 3, "_time": 1, "_pc": 1, "_usb": 90},
            {"type": "device", "id": "{D2}", "date": "01/04/2010 08:01:30", "user": "U1", "pc": "PC-2", "activity": "Disconnect", "content": "", "_act": 4, "_time": 1, "_pc": 1},
            {"type": "file", "id": "{F1}", "date": "01/04/2010 17:30:00", "user": "U1", "pc": "PC-9", "filename": "R:\\a\\b.zip", "activity": "File Copy", "to": "True", "from": "False", "content": "one two three", "_act": 7, "_time": 1, "_pc": 3},
            {"type": "file", "id": "{F2}", "date": "01/09/2010 12:00:00", "user": "U1", "pc": "PC-7", "filename": "C:\\b.exe", "activity": "File Open", "to": "False", "from": "True", "content": "x", "_act": 7, "_time": 3, "_pc": 2},
            {"type": "http", "id": "{H1}", "date": "01/10/2010 23:00:00", "user": "U2", "pc": "PC-9", "url": "http://www.dropbox.com/a/b", "activity": "WWW Upload", "content": "a b, c", "_site": 3, "_act": 5, "_time": 4, "_pc": 0},
            {"type": "email", "id": "{E1}", "date": "01/05/2010 09:00:00", "user": "U2", "pc": "PC-9", "to": "a@dtaa.com;b@x.com", "cc": "", "bcc": "c@y.org", "from": "u@dtaa.com", "activity": "Send", "size": 1234, "n_att": 2, "att": "a.doc(30);b.zip(4);c.odd(5)", "content": "hello there", "_act": 6, "_time": 1, "_pc": 0},
            {"type": "email", "id": "{E2}", "date": "01/05/2010 09:00:01", "user": "U3", "pc": "PC-5", "to": "a@dtaa.com", "cc": "d@dtaa.com", "bcc": "", "from": "u@dtaa.com", "activity": "View", "size": 1, "n_att": 0, "att": "x.txt(7)", "content": "w", "_act": 6, "_time": 1, "_pc": 2},
        ]
        folder = tmp_path / version
        folder.mkdir()
        for kind in ("logon", "device", "http", "email", "file"):
            names = [f.name for f in log_schema(version, kind)]
            with open(folder / f"{kind}.csv", "w", newline="") as f:
                w = csv.writer(f)
                w.writerow(names)
                w.writerows([[r.get(n, "") for n in names] for r in rows if r["type"] == kind])
                if kind == "logon":
                    w.writerow(["{bad}", "no date", "U1", "PC-1", "Logon"])
        users = spark.createDataFrame([("U1", "PC-1", ["PC-2"], "U2"), ("U2", "PC-9", None, None), ("U3", None, None, None)], "user string, pc string, sharedpc array<string>, sup string")
        insiders = spark.createDataFrame([(2, "b.csv", "U1", "2010-01-04", "2010-01-05")], "scenario int, details string, user string, mstart string, mend string").selectExpr("scenario", "details", "user", "CAST(mstart AS TIMESTAMP) mstart", "CAST(mend AS TIMESTAMP) mend")
        answers = spark.createDataFrame([("U1", "{F1}"), ("U2", "{H1}")], "user string, actid string")
        got = numeric_actions(R.read_activity(spark, str(folder), version), users, insiders, answers, version, "2010-01-03", "2010-01-04")
        table = {r["actid"]: r.asDict() for r in got.collect()}
        assert set(table) == {r["id"] for r in rows} and len(got.columns) == {"r4.2": 31, "r5.2": 49, "r6.2": 50}[version]
        features = [c for c in got.columns if c not in ("actid", "pcid", "ts", "user", "day", "week", "act", "pc", "time", "usb_dur", "mal_act", "insider")]
        for r in rows:
            out, want = table[r["id"]], literal_action(version, r)
            assert {c: out[c] for c in features} == {c: want.get(c, 0) for c in features}, (version, r["id"])
            assert set(want) <= set(features)
            assert (out["act"], out["time"], out["pc"], out["pcid"], out["usb_dur"]) == (r["_act"], r["_time"], r["_pc"], r["pc"], r.get("_usb", 0))
            assert (out["mal_act"], out["insider"]) == ((1, 2) if r["id"] == "{F1}" else (0, 0))
        assert table["{H1}"]["day"] == 6 and table["{H1}"]["week"] == 1 and table["{L1}"]["day"] == 0
        days = {(r["user"], r["day"]): r for r in day_features(got, version).collect()}
        assert days["U1", 0]["insider"] == 2 and days["U1", 0]["n_allact"] == 4 and days["U2", 1]["email_mean_n_des"] == 3
        if new:
            assert days["U1", 0]["n_compf" if "n_compf" in days["U1", 0] else "file_n_compf"] == 1 and days["U1", 0]["file_n-to_usb1"] == 1 and days["U2", 1]["email_mean_e_att_sdoc"] == 30
