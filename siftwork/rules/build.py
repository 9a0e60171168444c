"""Rules on build files (settings), and on shell access."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.rules.registry import at, occurrences, register, setting, where
from siftwork.sources.facts import Facts


def _engine(facts: Facts, config: dict) -> DataFrame:
    run = setting(facts, "engine").select("doc_id", F.col("value").alias("ran"))
    return at(setting(facts, "build-engine").join(run, "doc_id").filter("value <> ran"), "the build uses $value, the document asks for $ran")


def _shell(needed: bool):
    def run(facts: Facts, config: dict) -> DataFrame:
        on = setting(facts, "build-shell-escape")
        uses = occurrences(facts, "shell")
        if needed:
            off = on.filter("value = 'on'").select("doc_id")
            return at(uses.filter("detail = 'needs-shell'").join(off, "doc_id", "left_anti"), "the build gives no shell access")
        return at(on.filter("value = 'on'").join(uses.select("doc_id").distinct(), "doc_id", "left_anti"), "nothing needs shell access")

    return run


def _custom(missing: bool):
    def run(facts: Facts, config: dict) -> DataFrame:
        rules = facts["settings"].filter("key LIKE 'build-rule:%'").withColumn("ext", F.expr("substr(key, 12)"))
        ext = F.regexp_extract("path", r"\.(\w+)$", 1)
        written = facts["written_files"].select("doc_id", ext.alias("ext")).filter("ext <> ''").distinct()
        if missing:
            needs = facts["settings"].filter("key = 'needs-rule'").withColumn("ext", F.col("value"))
            return at(needs.join(rules.select("doc_id", "ext"), ["doc_id", "ext"], "left_anti"), "no rule makes .$ext files")
        return at(rules.join(written, ["doc_id", "ext"], "left_anti"), "no .$ext file is written")

    return run


def _bibliography(needed: bool):
    def run(facts: Facts, config: dict) -> DataFrame:
        cites = occurrences(facts, "cite").select("doc_id").distinct()
        mode = setting(facts, "build-bibliography")
        return at(mode.filter("value = 'off'").join(cites, "doc_id", "left_semi"), "citations, but the build makes no bibliography") if needed else at(mode.filter("value = 'on'").join(cites, "doc_id", "left_anti"), "nothing is cited")

    return run


register("C003", "build-bibliography-disabled", "error", _bibliography(True), "settings", "occurrences")
register("C004", "build-command-placeholders", "error", where("settings", "key LIKE 'build-command%' AND NOT value RLIKE '%[SOBDR]'", "the command names no file: $value"), "settings")
register("C005", "build-engine-mismatch", "error", _engine, "settings")
register("C006", "build-shell-escape-missing", "error", _shell(True), "settings", "occurrences")
register("C019", "build-missing-custom-dependency", "warning", _custom(True), "settings")
register("S023", "build-bibliography-unneeded", "info", _bibliography(False), "settings", "occurrences")
register("S024", "build-engine-options", "info", where("settings", "key LIKE 'build-command%' AND value RLIKE '-(interaction|file-line-error|synctex)'", "options belong in their own setting: $value"), "settings")
register("S025", "build-unused-custom-dependency", "info", _custom(False), "settings", "written_files")
register("X001", "build-shell-escape-unneeded", "warning", _shell(False), "settings", "occurrences")
register("X002", "shell-escape", "warning", lambda f, c: at(occurrences(f, "shell"), "runs a shell command: $key"), "occurrences")
