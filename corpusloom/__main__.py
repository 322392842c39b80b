"""python -m corpusloom {ingest,index,ask,list,delete}"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom.plans import ingest as plans
from corpusloom.settings import Settings


def main(arguments: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="corpusloom")
    p.add_argument("--out", default="corpus", help="folder of symbols and index")
    sub = p.add_subparsers(dest="step", required=True)
    one = sub.add_parser("ingest", help="parse a repository tree")
    one.add_argument("root")
    one.add_argument("repo")
    one.add_argument("--url")
    one.add_argument("--force", action="store_true", help="delete what is indexed of the repository first")
    one.add_argument("--settings", help="JSON file of what is left out")
    embed = sub.add_parser("index", help="embed the candidates")
    embed.add_argument("--repo")
    sub.add_parser("list", help="show the registry")
    sub.add_parser("delete", help="remove a repository").add_argument("repo")
    ask = sub.add_parser("ask", help="build a prompt for a question")
    ask.add_argument("question")
    ask.add_argument("--repo")
    ask.add_argument("-k", type=int, default=20)
    a = p.parse_args(arguments)
    spark = SparkSession.builder.appName("corpusloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.step == "ingest":
        plans.register(spark, a.out, a.repo, a.url, a.force)
        plans.ingest(spark, a.root, a.repo, a.out, Settings.load(a.settings))
    elif a.step == "index":
        plans.index(spark, a.out, repo=a.repo)
        waiting = plans.registered(spark, a.out).where("status = 'indexing'").select("name")
        for row in (waiting.where(F.col("name") == a.repo) if a.repo else waiting).toLocalIterator():
            plans.finish(spark, a.out, row.name)
    elif a.step == "list":
        plans.registered(spark, a.out).orderBy("name").show(1000, truncate=False)
    elif a.step == "delete":
        plans.delete(spark, a.out, a.repo)
    else:
        for row in plans.ask(spark, a.out, spark.createDataFrame([(a.question,)], "question string"), a.k, repo=a.repo).collect():
            print(row.prompt)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
