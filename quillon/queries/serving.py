"""Streams, user functions and request options over the driver's tables."""

from __future__ import annotations

import json
import subprocess
import uuid
from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F

from quillon.cluster import shared_folder
from quillon.operators import catalogue, facets, load, merge, parallel, profile, tables
from quillon.plans import build, options
from quillon.queries.loading import _customers
from quillon.registry import Tables, query
from quillon.sources import acquire
from quillon.streaming import ingest as stream


def _days(spark, d):
    """Events as files of a folder, as they would come in."""
    path = f"{shared_folder(spark)}/events-{uuid.uuid4().hex[:8]}"
    events = Tables(spark, d).events
    events.repartition(4, "event_id").write.parquet(path)
    return path, events.schema


@query("t_incremental_apply", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def t_incremental_apply(spark, d):
    path, schema = _days(spark, d)
    keeper = stream.Upserter(spark, "user_id", "event_id")

    def apply(batch, number):
        keeper(batch.select("user_id", "event_id", "event_type"), number)

    stream.ingest(spark, path, schema, apply, files_per_batch=100)
    return keeper.read().select("user_id", "event_type", "event_id")


@query("t_parallel_upload", "SELECT n_nationkey AS n, n_name FROM nation")
def t_parallel_upload(spark, d):
    t = Tables(spark, d).nation
    return parallel.loaded_in_parts(spark, list(range(5)), lambda r: t.filter(F.col("n_regionkey") == r)).select(F.col("n_nationkey").alias("n"), "n_name")


for _name in ("t_job_process", "t_constraints"):
    query(_name, "SELECT 'nation' AS job, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'supplier', count(*) FROM supplier")(
        lambda spark, d: parallel.run_jobs(spark, {n: (lambda n=n: getattr(Tables(spark, d), n).count()) for n in ("nation", "region", "supplier")}, at_once=2)
    )


@query("t_poll", "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id")
def t_poll(spark, d):
    jobs = Tables(spark, d).events.withColumn("pending", F.array("event_type"))
    return facets.group_count(stream.pending(jobs, "error"), "user_id")


@query("t_change_watcher", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def t_change_watcher(spark, d):
    path, schema = _days(spark, d)
    out = f"{shared_folder(spark)}/changes-{uuid.uuid4().hex[:8]}"
    stream.ingest(spark, path, schema, lambda batch, number: facets.group_count(batch, "event_type").write.mode("overwrite").parquet(f"{out}/b{number}"), "changes")
    return spark.read.parquet(out + "/*").groupBy("event_type").agg(F.sum("n").alias("n"))


@query("t_cron", "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def t_cron(spark, d):
    out = stream.windowed_counts(Tables(spark, d).events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "1 day", "event_type")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


# user functions


def _lengths(batch: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"n": batch["name"].str.len()})


@query("a_parallel_agg", "SELECT CAST(sum(length(c_name)) AS BIGINT) AS n FROM customer")
def a_parallel_agg(spark, d):
    return parallel.fold_sum(_customers(spark, d).select("name"), _lengths, "n")


for _name in ("u_parallel_fn", "g_jobs_parallel", "g_parallel_fold"):
    query(_name, "SELECT CAST(sum(length(c_name)) AS BIGINT) AS n FROM customer WHERE c_mktsegment = 'BUILDING'")(lambda spark, d: parallel.fold_sum(_customers(spark, d).filter("seg = 'BUILDING'").select("name"), _lengths, "n"))


def _id_files(spark, d, folders):
    """Files of ids, one a line, with empty lines and repeats."""
    path = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex[:8]}"
    ids = Tables(spark, d).customer.filter("c_mktsegment = 'BUILDING'")
    text = F.explode(F.array(F.col("c_custkey").cast("string"), F.lit("")))
    for k in range(folders):
        ids.filter(F.col("c_custkey") % folders == k).select(text.alias("value")).write.text(f"{path}/{k}")
    return path


@query("u_parallel_file", "SELECT c_custkey AS _id, length(c_name) AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
def u_parallel_file(spark, d):
    ids = parallel.listed_ids(spark, _id_files(spark, d, 1) + "/0")
    return parallel.over_ids(_customers(spark, d).select("_id", "name"), ids, lambda b: pd.DataFrame({"_id": b["_id"], "n": b["name"].str.len()}), "_id bigint, n bigint")


@query("u_parallel_dir", "SELECT CAST(sum(length(c_name)) AS BIGINT) AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
def u_parallel_dir(spark, d):
    ids = parallel.listed_ids(spark, _id_files(spark, d, 3) + "/*")
    return parallel.over_ids(_customers(spark, d).select("_id", "name"), ids, _lengths, "n bigint").agg(F.sum("n").alias("n"))


def _parser(argument):
    for i in range(3):
        yield {"_id": f"{argument}:{i}", "n": i}


@query("u_load_data", "SELECT a || ':' || CAST(i AS VARCHAR) AS _id, CAST(i AS BIGINT) AS n FROM (VALUES ('x'), ('y')) t(a), range(3) r(i)")
def u_load_data(spark, d):
    return parallel.parse_arguments(spark, ["x", "y"], _parser, "_id string, n bigint")


@query("u_get_mapping", "SELECT column_name AS field, CASE data_type WHEN 'BIGINT' THEN 'integer' WHEN 'INTEGER' THEN 'integer' WHEN 'VARCHAR' THEN 'keyword' WHEN 'DOUBLE' THEN 'float' END AS type FROM information_schema.columns WHERE table_name = 'customer'")
def u_get_mapping(spark, d):
    return spark.createDataFrame(profile.schema_rows(profile.mapping(Tables(spark, d).customer.schema)), "field string, type string")


def _upper(batch: pd.DataFrame) -> pd.DataFrame:
    return batch.assign(name=batch["name"].str.upper())


for _name in ("u_cleaner", "u_mapper"):
    query(_name, "SELECT c_custkey AS _id, upper(c_name) AS name FROM customer")(lambda spark, d: parallel.map_documents(_customers(spark, d).select("_id", "name"), _upper, "_id bigint, name string"))


@query("u_doc_query", "SELECT c_custkey AS _id FROM customer WHERE c_acctbal > 5000")
def u_doc_query(spark, d):
    return build.Build(predicates={"customers": "bal > 5000"}).run({"customers": _customers(spark, d)}).select("_id")


def _sources(spark, d):
    c = _customers(spark, d)
    return {"names": c.select("_id", "name"), "segments": c.filter("_id % 2 = 0").select("_id", "seg")}


@query("u_post_merge", "SELECT c_custkey AS _id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'none' END AS seg, 'names,segments' AS built FROM customer")
def u_post_merge(spark, d):
    def after(merged, names):
        return merged.fillna("none", ["seg"]).withColumn("built", F.lit(",".join(names)))

    return build.Build(post_merge=after).run(_sources(spark, d)).select("_id", "name", "seg", "built")


@query("u_custom_meta", "SELECT count(*) AS total, 'names,segments' AS sources, 'mine' AS note FROM customer")
def u_custom_meta(spark, d):
    made = build.Build(custom_metadata=lambda merged, names: {"note": "mine"})
    sources = _sources(spark, d)
    meta = made.metadata(made.run(sources), sorted(sources))
    return spark.createDataFrame([(meta["stats"]["total"], ",".join(meta["sources"]), meta["note"])], "total bigint, sources string, note string")


@query("g_transparent_mapper", "SELECT c_custkey AS _id, c_name AS name FROM customer")
def g_transparent_mapper(spark, d):
    return build.Build(mappers={"names": build.transparent}).run({"names": _sources(spark, d)["names"]}).select("_id", "name")


@query("g_autobuild_flags", "SELECT * FROM (VALUES ('autobuild', 'full'), ('autobuild', 'incremental'), ('autorelease', 'incremental')) v(step, type)")
def g_autobuild_flags(spark, d):
    config = {"autobuild": {"schedule": "0 6 * * *", "type": True}, "autopublish": False, "autorelease": {"type": "incremental"}}
    return spark.createDataFrame(catalogue.automatic_steps(config), "step string, type string")


@query("g_prebuild_redis", "SELECT DISTINCT CAST(k AS VARCHAR) AS _id FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT o_custkey FROM orders)")
def g_prebuild_redis(spark, d):
    t = Tables(spark, d)
    return merge.registry({"customer": t.customer.select(F.col("c_custkey").alias("_id")), "orders": t.orders.select(F.col("o_custkey").alias("_id"))}).select("_id")


@query("g_list2dict_common", "SELECT n_regionkey, array_to_string(list(n_name || ':' || n_nationkey ORDER BY n_nationkey), ',') AS items FROM nation GROUP BY 1")
def g_list2dict_common(spark, d):
    out = tables.group_values(Tables(spark, d).nation, ["n_regionkey"], F.concat_ws(":", "n_name", F.col("n_nationkey").cast("string")), F.col("n_nationkey"))
    return out.select("n_regionkey", F.array_join("values", ",").alias("items"))


@query("u_edge", "SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS orig, CAST(c_nationkey AS VARCHAR) AS cur FROM customer")
def u_edge(spark, d):
    from quillon.plans.keygraph import Edge

    c = Tables(spark, d).customer
    return Edge("customer", "nation", c, "c_custkey", "c_nationkey").follow(c.select(F.col("c_custkey").cast("string").alias("orig"), F.col("c_custkey").cast("string").alias("cur")))


@query("u_transform_dec", "SELECT CAST(n_regionkey AS VARCHAR) AS _id, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def u_transform_dec(spark, d):
    from quillon.plans.keygraph import convert
    from quillon.queries.building import _edges

    c = Tables(spark, d).customer
    docs = c.select(F.col("c_custkey").cast("string").alias("_id"), F.col("c_name").alias("name"))
    return docs.transform(lambda x: convert(x, _edges(spark, d), [("customer", "_id")], ["region"]))


@query("u_lookup_one", "SELECT CAST(n_regionkey AS VARCHAR) AS cur FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7")
def u_lookup_one(spark, d):
    from quillon.plans.keygraph import travel
    from quillon.queries.building import _edges

    return travel(spark.createDataFrame([("7",)], "orig string"), _edges(spark, d), "customer", "region").select("cur")


@query("i_parser_validator", "SELECT 'no id' AS problem, count(*) AS n FROM customer WHERE c_custkey % 10 = 0")
def i_parser_validator(spark, d):
    docs = _customers(spark, d).select(F.when(F.col("_id") % 10 != 0, F.col("_id").cast("string")).alias("_id"))
    return parallel.checked_parser_output(docs)


# request options


@query("x_option_parse", "SELECT * FROM (VALUES ('fields', '[''a'', ''b c'']'), ('q', 'cdk2'), ('raw', 'True'), ('size', '25')) v(option, value)")
def x_option_parse(spark, d):
    known = {"q": options.Option("str"), "size": options.Option("int", default=10, maximum=1000, alias=("limit",)), "fields": options.Option("list", default=["all"]), "raw": options.Option("bool", default=False)}
    got = options.parse(known, {"q": "cdk2", "limit": "25", "fields": 'a,"b c"', "raw": "yes"})
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(got.items())], "option string, value string")


@query("x_validate_opt", "SELECT * FROM (VALUES ('5', '5'), ('5000', 'size is above 1000'), ('x', chr(39) || 'x' || chr(39) || ' is not of the type int')) v(value, outcome)")
def x_validate_opt(spark, d):
    rows = []
    for value in ("5", "5000", "x"):
        try:
            rows.append((value, str(options.parse({"size": options.Option("int", maximum=1000)}, {"size": value})["size"])))
        except options.OptionError as e:
            rows.append((value, str(e)))
    return spark.createDataFrame(rows, "value string, outcome string")


@query("ensure_backend_mem", "SELECT c_custkey AS _id, c_name AS name FROM customer")
def ensure_backend_mem(spark, d):
    docs = _customers(spark, d).select("_id", "name")
    return load.upsert(docs, docs)


# fetching


def _place(spark, name):
    folder = shared_folder(spark)
    path = Path(folder.removeprefix("file:").replace("///", "/").replace("//", "/")) / f"{name}-{uuid.uuid4().hex[:8]}"
    path.mkdir(parents=True)
    return path


def _fetched(spark, status, schema="n_nationkey int, n_name string"):
    return spark.read.schema(schema).json(status.folder)


def _offered(spark, d):
    """Two files of nations, as some site would offer them."""
    place = _place(spark, "offered")
    rows = [r.asDict() for r in Tables(spark, d).nation.select("n_nationkey", "n_name").orderBy("n_nationkey").collect()]  # 25 rows
    for i in range(2):
        (place / f"part{i}.json").write_text("\n".join(json.dumps(r) for r in rows[i::2]))
    return place


_NATIONS = "SELECT n_nationkey, n_name FROM nation"


@query("n_fs", _NATIONS)
def n_fs(spark, d):
    return _fetched(spark, acquire.FolderAcquirer(_offered(spark, d), _place(spark, "got"), pattern="*.json").run())


@query("n_base", "SELECT * FROM (VALUES ('first', 2, 0), ('second', 0, 2), ('forced', 2, 0)) v(run, fetched, skipped)")
def n_base(spark, d):
    source = acquire.FolderAcquirer(_offered(spark, d), _place(spark, "got"), version="1")
    runs = [("first", source.run()), ("second", source.run()), ("forced", source.run(force=True))]
    return spark.createDataFrame([(n, len(s.fetched), len(s.skipped)) for n, s in runs], "run string, fetched int, skipped int")


@query("n_http", _NATIONS)
def n_http(spark, d):
    urls = [p.as_uri() for p in sorted(_offered(spark, d).glob("*"))]
    return _fetched(spark, acquire.UrlAcquirer(urls, _place(spark, "got")).run())


@query("n_lm_http", "SELECT n_nationkey, n_name, 2 AS skipped FROM nation")
def n_lm_http(spark, d):
    urls = [p.as_uri() for p in sorted(_offered(spark, d).glob("*"))]
    source = acquire.DatedUrlAcquirer(urls, _place(spark, "got"), version="1")
    source.run()
    again = source.run()
    return _fetched(spark, again).withColumn("skipped", F.lit(len(again.skipped)))


@query("n_dummy", "SELECT 0 AS fetched, true AS ran")
def n_dummy(spark, d):
    ran = []
    status = acquire.NoAcquirer(_place(spark, "got"), post=ran.append).run()
    return spark.createDataFrame([(len(status.fetched), bool(ran))], "fetched int, ran boolean")


@query("n_manual", _NATIONS)
def n_manual(spark, d):
    return _fetched(spark, acquire.ManualAcquirer(_offered(spark, d)).run())


@query("n_api", _NATIONS)
def n_api(spark, d):
    def documents():
        for r in Tables(spark, d).nation.select("n_nationkey", "n_name").toLocalIterator():
            yield r.asDict()

    return _fetched(spark, acquire.ApiAcquirer(documents, _place(spark, "got"), per_file=10).run())


@query("n_release", "SELECT * FROM (VALUES ('1.2.json'), ('2.3.json')) v(name)")
def n_release(spark, d):
    place = _place(spark, "feed")
    releases = [{"target": "1"}, {"target": "2", "requires": "1"}, {"target": "3", "requires": "2"}, {"target": "3"}]
    for i, r in enumerate(releases):
        (place / f"{i}.json").write_text(json.dumps(r))
        r["url"] = (place / f"{i}.json").as_uri()
    (place / "versions.json").write_text(json.dumps(releases))
    status = acquire.ReleaseAcquirer((place / "versions.json").as_uri(), _place(spark, "got"), current="1").run()
    return spark.createDataFrame([(n,) for n in status.fetched], "name string")


@query("n_s3", _NATIONS)
def n_s3(spark, d):
    target = f"{shared_folder(spark)}/objects-{uuid.uuid4().hex[:8]}"
    for p in sorted(_offered(spark, d).glob("*.json")):
        acquire.put_object(spark, str(p), f"{target}/{p.name}")
    return spark.read.schema("n_nationkey int, n_name string").json(target)


class _FolderServer:
    """Stands in for an FTP server: it serves a folder."""

    def __init__(self, host):
        self.folder = Path(host)

    def login(self):
        return "230"

    def cwd(self, path):
        self.folder = self.folder / path

    def nlst(self):
        return [p.name for p in self.folder.iterdir()]

    def voidcmd(self, command):
        return "213 20240102030405"

    def retrbinary(self, command, write):
        write((self.folder / command.removeprefix("RETR ")).read_bytes())


@query("n_ftp", _NATIONS)
def n_ftp(spark, d):
    return _fetched(spark, acquire.FtpAcquirer(str(_offered(spark, d)), ".", _place(spark, "got"), r"part\d\.json", connect=_FolderServer).run())


@query("n_lm_ftp", "SELECT n_nationkey, n_name, '20240102' AS version FROM nation")
def n_lm_ftp(spark, d):
    status = acquire.DatedFtpAcquirer(str(_offered(spark, d)), ".", _place(spark, "got"), connect=_FolderServer).run()
    return _fetched(spark, status).withColumn("version", F.lit(status.version))


@query("n_gdrive", "SELECT * FROM (VALUES ('a', 'https://drive.google.com/uc?export=download&id=x-1'), ('b', 'https://drive.google.com/uc?export=download&id=y2')) v(name, url)")
def n_gdrive(spark, d):
    source = acquire.DriveAcquirer({"a": "https://drive.google.com/file/d/x-1/view", "b": "https://drive.google.com/open?id=y2"}, _place(spark, "got"))
    return spark.createDataFrame([(r.name, r.place) for r in source.listing()], "name string, url string")


def _stand_in(spark, text):
    """A program of the operating system's shell, in place of one that needs a network or a daemon."""
    path = _place(spark, "bin") / "program"
    path.write_text("#!/bin/sh\n" + text)
    path.chmod(0o755)
    return str(path)


@query("n_docker", _NATIONS)
def n_docker(spark, d):
    whole = _place(spark, "container") / "nations.json"
    whole.write_text("\n".join(p.read_text() for p in sorted(_offered(spark, d).glob("*.json"))))
    program = _stand_in(spark, 'test "$1" = cp && cp "${2#box:}" "$3"\n')
    return _fetched(spark, acquire.ContainerAcquirer("box", str(whole), _place(spark, "got"), program=program).run())


@query("n_wget", _NATIONS)
def n_wget(spark, d):
    program = _stand_in(spark, 'for a; do case "$last" in --directory-prefix) to="$a";; esac; last="$a"; done; cp "$last"/* "$to"\n')
    return _fetched(spark, acquire.MirrorAcquirer(str(_offered(spark, d)), _place(spark, "got"), program=program).run())


@query("n_git", _NATIONS)
def n_git(spark, d):
    place = _offered(spark, d)
    for command in (["init", "-q"], ["add", "."], ["-c", "user.name=x", "-c", "user.email=x@example.org", "commit", "-q", "-m", "files"]):
        subprocess.run(["git", "-C", str(place), *command], check=True, capture_output=True)
    return _fetched(spark, acquire.GitAcquirer(str(place), _place(spark, "got")).run())
