"""The line-oriented front end: ``<program> <verb> [--name value ...]`` per line.

Verbs, in any case: init, put, get, del, stats, close, flush-now, list-sst, sst-info,
manifest-info, version-info. Unknown verbs and lines of one word give nothing. Errors are
printed at once as ``<kind>: <text>``.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession

from tidelog.engine import Store
from tidelog.model import Config, EngineError, InvalidArgument


def tokenize(line: str) -> list[str]:
    """Words between blanks. Single or double quotes group, and hold the other kind as
    text; a closing quote ends the word, an opening one doesn't; an empty quoted word is
    kept; there are no escapes; an open quote is an error."""
    words, word, quote = [], [], None
    for c in line:
        if quote:
            if c == quote:
                words.append("".join(word))
                word, quote = [], None
            else:
                word.append(c)
        elif c in "'\"":
            quote = c
        elif c != " ":
            word.append(c)
        elif word:
            words.append("".join(word))
            word = []
    if quote:
        raise ValueError("a quote isn't closed")
    if word:
        words.append("".join(word))
    return words


def flags(words: list[str]) -> dict[str, str]:
    """``--name value`` pairs from the third word on; a value can't start with dashes."""
    pairs = zip(words[2:], words[3:])
    return {a.replace("-", ""): b for a, b in pairs if a.startswith("--") and not b.startswith("--")}


def _run_line(r: dict, created: bool = False) -> str:
    text = lambda h: bytes.fromhex(h).decode("utf-8", "replace")
    at = f"createdAt={r['created_at']}, " if created else ""
    return (
        f"id={r['id']}, {at}fileSize={r['size']}, minSeqNo={r['min_seq_no']}, maxSeqNo={r['max_seq_no']}, "
        f"minKey={text(r['min_key'])}, maxKey={text(r['max_key'])}"
    )


class Shell:
    def __init__(self, spark: SparkSession, default_config: str = "config/default.json"):
        self.spark, self.default_config, self.store = spark, default_config, None
        self.done = False

    def execute(self, line: str) -> list[str]:
        """The output lines of one command."""
        try:
            words = tokenize(line)
            if len(words) < 2:
                return []
            verb = words[1].lower().replace("-", "_")
            action = getattr(self, f"do_{verb}", None)
            if action is None:
                return []
            if verb != "init" and self.store is None:
                raise InvalidArgument("init comes first")
            return action(flags(words))
        except (EngineError, ValueError) as e:
            return [f"{type(e).__name__}: {e}"]

    def _key(self, given: dict) -> bytes:
        if "key" not in given:
            raise InvalidArgument("--key is missing")
        return given["key"].encode()

    def do_init(self, given: dict) -> list[str]:
        if self.store is not None:
            raise InvalidArgument("the store is open")
        path = given.get("config") or (self.default_config if os.path.exists(self.default_config) else None)
        self.store = Store.open(self.spark, Config.load(path))
        self.store.interval = 5.0
        return ["ok"]

    def do_put(self, given: dict) -> list[str]:
        key = self._key(given)
        if "value" not in given:
            raise InvalidArgument("--value is missing")
        self.store.put(key, given["value"].encode())
        return ["ok"]

    def do_get(self, given: dict) -> list[str]:
        return [self.store.get(self._key(given)).decode("utf-8", "replace")]

    def do_del(self, given: dict) -> list[str]:
        self.store.delete(self._key(given))
        return ["ok"]

    def do_stats(self, given: dict) -> list[str]:
        return [f"{k}={v}" for k, v in self.store.stats().items()]

    def do_close(self, given: dict) -> list[str]:
        self.store.close()
        self.done = True
        return ["ok"]

    def do_flush_now(self, given: dict) -> list[str]:
        run = self.store.flush_now()
        return [f"{run['id']} {run['size']}" if run else "nothing to flush"]

    def do_list_sst(self, given: dict) -> list[str]:
        return [_run_line(r, True) for r in self.store.list_sst()]

    def do_sst_info(self, given: dict) -> list[str]:
        if "filename" not in given:
            raise InvalidArgument("--filename is missing")
        info = self.store.sst_info(given["filename"])
        lines = [_run_line(info), f"blocks={info['blocks']}, dataBytes={info['data_bytes']}, intact={str(info['intact']).lower()}"]
        for no, (size, good) in enumerate(zip(info["block_sizes"] or [], info["checksums"] or [])):
            lines.append(f"block {no}: size={size}, Checksum {'OK' if good else 'BAD'}")
        return lines

    def do_manifest_info(self, given: dict) -> list[str]:
        info = self.store.manifest_info()
        return [str(info["epoch"]), *[_run_line(r) for r in info["runs"]]]

    def do_version_info(self, given: dict) -> list[str]:
        info = self.store.version_info()
        return [f"epoch: {info['epoch']}", *[f"size: {n}" for n in info["immutables"]], *[_run_line(r) for r in info["runs"]]]


def main() -> None:
    shell = Shell(SparkSession.builder.appName("tidelog").getOrCreate())
    for line in sys.stdin:
        for out in shell.execute(line.rstrip("\n")):
            print(out, flush=True)
        if shell.done:
            break


if __name__ == "__main__":
    main()
