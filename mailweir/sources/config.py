"""Configuration: JSON text to typed rows or to an object, with defaults and checks."""

from __future__ import annotations

import json
import socket
from dataclasses import MISSING, asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Defaults of a server and of the processing.
SERVER_DEFAULTS = {"max_clients": 100, "timeout": 30, "max_size": 10 << 20}
LISTEN, PROCESS = "127.0.0.1:2525", "HeadersParser|Header|Debugger"

SERVER = "struct<listen_interface:string,host_name:string,max_size:bigint,timeout:int,max_clients:int,is_enabled:boolean,log_file:string,xclient_on:boolean,tls:struct<start_tls_on:boolean,tls_always_on:boolean,private_key_file:string,public_key_file:string,protocols:array<string>,ciphers:array<string>,curves:array<string>,client_auth_type:string>>"
APP = f"struct<servers:array<{SERVER}>,allowed_hosts:array<string>,pid_file:string,log_file:string,log_level:string,backend_config:map<string,string>>"


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """file and text of every configuration file under a path."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def parsed(text: Column) -> Column:
    """A configuration's struct, null for malformed JSON."""
    return F.from_json(text, APP)


def _filled(value: Column, default: Column) -> Column:
    """The default for what is missing, empty or zero."""
    return F.when(value.isNull() | value.cast("string").isin("", "0"), default).otherwise(value)


def app_rows(configs: DataFrame, text: str = "text", host: str | None = None) -> DataFrame:
    """Every configuration with its defaults: servers (one at least), allowed_hosts, pid_file, log_file, log_level, backend_config, and error.

    error says what is wrong: no JSON, or a server without a listen interface or (with TLS) without key files; null if nothing is.
    """
    host_ = F.lit(host or socket.gethostname())
    c = parsed(F.col(text))
    log_file = F.coalesce(F.nullif(c["log_file"], F.lit("")), F.lit("stderr"))
    names = ["listen_interface", "host_name", "max_size", "timeout", "max_clients", "is_enabled", "log_file", "xclient_on", "tls"]

    def server(s: Column) -> Column:
        made = {
            "listen_interface": s["listen_interface"], "host_name": _filled(s["host_name"], host_), "log_file": _filled(s["log_file"], log_file), "is_enabled": F.coalesce(s["is_enabled"], F.lit(False)),
            "xclient_on": F.coalesce(s["xclient_on"], F.lit(False)), "tls": s["tls"], **{k: _filled(s[k], F.lit(v)) for k, v in SERVER_DEFAULTS.items()},
        }
        return F.struct(*(made[n].alias(n) for n in names))

    alone = F.struct(F.lit(LISTEN).alias("listen_interface"), host_.alias("host_name"), *(F.lit(SERVER_DEFAULTS[k]).cast("bigint" if k == "max_size" else "int").alias(k) for k in ("max_size", "timeout", "max_clients")), F.lit(True).alias("is_enabled"), log_file.alias("log_file"), F.lit(False).alias("xclient_on"), F.from_json(F.lit("null"), SERVER)["tls"].alias("tls"))
    servers = F.when(F.coalesce(F.size(c["servers"]), F.lit(0)) <= 0, F.array(alone)).otherwise(F.transform(c["servers"], server))
    given = F.coalesce(c["backend_config"], F.expr("cast(map() as map<string,string>)"))
    base = F.create_map(F.lit("save_process"), F.lit(PROCESS), F.lit("primary_mail_host"), host_, F.lit("save_workers_size"), F.lit("1"), F.lit("log_received_mails"), F.when(F.size(given) == 0, "true").otherwise("false"))
    backend = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(given, k)), given)
    blank = lambda x: F.coalesce(x, F.lit("")) == ""
    encrypted = lambda s: F.coalesce(s["tls"]["start_tls_on"], F.lit(False)) | F.coalesce(s["tls"]["tls_always_on"], F.lit(False))
    error = (
        F.when(c.isNull(), "could not parse config file")
        .when(F.exists("servers", lambda s: blank(s["listen_interface"])), "listen interface not specified")
        .when(F.exists("servers", lambda s: encrypted(s) & blank(s["tls"]["public_key_file"])), "PublicKeyFile is empty")
        .when(F.exists("servers", lambda s: encrypted(s) & blank(s["tls"]["private_key_file"])), "PrivateKeyFile is empty")
    )
    hosts = F.when(F.coalesce(F.size(c["allowed_hosts"]), F.lit(0)) <= 0, F.array(host_)).otherwise(c["allowed_hosts"])
    rows = configs.withColumns({"servers": servers, "allowed_hosts": hosts, "pid_file": F.coalesce(c["pid_file"], F.lit("")), "log_file": log_file, "log_level": F.coalesce(F.nullif(c["log_level"], F.lit("")), F.lit("debug")), "backend_config": backend})
    return rows.withColumn("error", error)


def server_rows(apps: DataFrame, *keep: str) -> DataFrame:
    """One row for each server of `app_rows`, with the columns that `keep` names."""
    return apps.select(*keep, F.explode("servers").alias("_s")).select(*keep, "_s.*")


def client_total(servers: DataFrame, *by: str) -> DataFrame:
    """How many clients the servers may have together, which the limit of open files must hold."""
    return servers.groupBy(*by).agg(F.sum("max_clients").alias("clients"))


def file_times(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path and seconds of the last change of key files, of their metadata alone."""
    return spark.read.format("binaryFile").load(paths).select("path", F.unix_timestamp("modificationTime").alias("changed"))


def enabled(servers: DataFrame) -> DataFrame:
    return servers.where("is_enabled")


def server(servers: DataFrame, interface: str) -> DataFrame:
    """The server of an interface."""
    return servers.where(F.col("listen_interface") == interface)


def typed(config: Column, spec: dict[str, tuple[str, bool]]) -> tuple[dict[str, Column], Column]:
    """Columns of a JSON object by name, type (int, string or bool) and whether they may be missing, and the error of the first that is missing or mistyped.

    Numbers lose their fraction where an int is wanted; nothing else is converted.
    """
    made, errors = {}, []
    for name, (kind, optional) in spec.items():
        raw = F.try_variant_get(F.try_parse_json(config), f"$.{name}", "variant")
        of = F.schema_of_variant(raw)
        wanted = {"int": of.rlike("^(BIGINT|DECIMAL.*|DOUBLE)$"), "string": of == "STRING", "bool": of == "BOOLEAN"}[kind]
        value = {"int": lambda r: F.try_variant_get(r, "$", "double").cast("bigint"), "string": lambda r: F.try_variant_get(r, "$", "string"), "bool": lambda r: F.try_variant_get(r, "$", "boolean")}[kind](raw)
        good = F.coalesce(wanted, F.lit(False))
        made[name] = F.when(good, value)
        if not optional:
            errors.append(F.when(~good, F.lit(f"property missing/invalid: '{name}' of expected type: {kind}")))
    return made, F.coalesce(*errors) if errors else F.lit(None).cast("string")


@dataclass
class Options:
    """Options of a processor: a dataclass whose fields are read from a configuration by `read_options`."""


def read_options(config: dict[str, Any], kind: type) -> Any:
    """An object of a dataclass from a configuration; fields without a default must be there with their type."""
    values = {}
    for f in fields(kind):
        value = config.get(f.name)
        wanted = {"int": int, "str": str, "bool": bool}.get(f.type if isinstance(f.type, str) else f.type.__name__, object)
        if wanted is int and isinstance(value, float):
            value = int(value)
        if isinstance(value, wanted) and not (wanted is int and isinstance(value, bool)):
            values[f.name] = value
        elif f.default is MISSING and f.default_factory is MISSING:
            raise ValueError(f"property missing/invalid: '{f.name}' of expected type: {wanted.__name__}")
    return kind(**values)


@dataclass
class Server:
    listen_interface: str = ""
    host_name: str = field(default_factory=socket.gethostname)
    max_size: int = SERVER_DEFAULTS["max_size"]
    timeout: int = SERVER_DEFAULTS["timeout"]
    max_clients: int = SERVER_DEFAULTS["max_clients"]
    is_enabled: bool = False
    log_file: str = ""
    xclient_on: bool = False
    tls: dict[str, Any] = field(default_factory=dict)

    def problems(self) -> list[str]:
        if self.tls.get("start_tls_on") or self.tls.get("tls_always_on"):
            return [f"{label} is empty" for name, label in (("public_key_file", "PublicKeyFile"), ("private_key_file", "PrivateKeyFile")) if not self.tls.get(name)]
        return []


@dataclass
class App:
    """A loaded configuration."""

    servers: list[Server]
    allowed_hosts: list[str]
    pid_file: str
    log_file: str
    log_level: str
    backend_config: dict[str, Any]

    @staticmethod
    def of(values: dict[str, Any]) -> App:
        """Fill in what is missing; raises ValueError for a server that can't run."""
        host, log_file = socket.gethostname(), values.get("log_file") or "stderr"
        servers = []
        for i, given in enumerate(values.get("servers") or [{"listen_interface": LISTEN, "is_enabled": True}]):
            server = Server(**{f.name: given[f.name] for f in fields(Server) if given.get(f.name)})
            server.log_file = server.log_file or log_file
            if not server.listen_interface:
                raise ValueError(f"listen interface not specified for server at index {i}")
            if problems := server.problems():
                raise ValueError("\n".join(problems))
            servers.append(server)
        given = values.get("backend_config") or {}
        backend = {"save_process": PROCESS, "primary_mail_host": host, "save_workers_size": 1, "log_received_mails": not given} | given
        return App(servers, values.get("allowed_hosts") or [host], values.get("pid_file") or "", log_file, values.get("log_level") or "debug", backend)

    @staticmethod
    def load(path: str) -> App:
        """A configuration file on the driver."""
        try:
            return App.of(json.loads(Path(path).read_text()))
        except json.JSONDecodeError as e:
            raise ValueError(f"could not parse config file: {e}") from e

    def with_overrides(self, pid_file: str | None = None) -> App:
        """What a command line says counts more than the file."""
        return App(**(vars(self) | ({"pid_file": pid_file} if pid_file else {})))

    def json(self) -> str:
        return json.dumps(asdict(self))
