"""python -m tidelog shell|server|client: the interactive shell, the TCP server, the TCP client."""

from __future__ import annotations

import argparse
import sys

from tidelog.config import Config


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tidelog").getOrCreate()


def shell(path: str) -> None:
    from tidelog.errors import TidelogError
    from tidelog.plans.session import run_script
    from tidelog.plans.store import Engine

    spark = _session()
    engine = Engine(spark, path)
    for line in sys.stdin:  # ends at the end of input
        if line.strip().lower() == "exit":
            break
        try:
            for r in run_script(engine, spark.createDataFrame([(0, line)], "seq long, line string"), "repl").collect():
                print(r["outcome"] if r["value"] is None else r["value"])
        except TidelogError as e:
            print(e)
    engine.stop()


def server(port: int, path: str) -> None:
    from tidelog.plans.store import Engine
    from tidelog.sources.wire import Server

    engine = Engine(_session(), path)
    try:
        Server(engine, port).serve_forever()
    finally:
        engine.stop()


def client(port: int) -> None:
    from tidelog.errors import TidelogError
    from tidelog.functions.lines import parse_line
    from tidelog.sources.wire import Client

    link = Client(port)
    for line in sys.stdin:
        op, key, value = parse_line(line)
        try:
            if op == "exit":
                break
            if op == "invalid":
                print("invalid command")
            elif op == "get":
                print("not found" if (found := link.get(key)) is None else found)
            else:
                link.set(key, value) if op == "set" else link.delete(key)
                print("ok")
        except TidelogError as e:
            print(e)
    link.close()


def main() -> None:
    config = Config.from_env()
    p = argparse.ArgumentParser(prog="tidelog")
    p.add_argument("what", choices=["shell", "server", "client"])
    p.add_argument("-p", "--port", type=int, default=config.port)
    p.add_argument("--path", default=config.path)
    a = p.parse_args()
    {"shell": lambda: shell(a.path), "server": lambda: server(a.port, a.path), "client": lambda: client(a.port)}[a.what]()


if __name__ == "__main__":
    main()
