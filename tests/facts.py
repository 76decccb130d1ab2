"""Hand-made fact tables for small projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from apiquarry import schemas
from apiquarry.functions import paths


def path(spark, df, column, style="braces"):
    """Turn a text column into a template; ``?expr`` segments become unresolved."""
    parsed = paths.parse_path(F.col(column), style)
    fixed = F.struct(
        F.transform(
            parsed["segments"],
            lambda s: F.when(
                s["value"].startswith("?"),
                paths.unresolved(F.substring(s["value"], F.lit(2), F.length(s["value"]))),
            ).otherwise(s),
        ).alias("segments"),
        # A route registered at "/" keeps its slash under the prefix it is mounted at.
        (parsed["trailing_slash"] | (F.col(column) == "/")).alias("trailing_slash"),
    )
    return df.withColumn(column, fixed)


def table(spark, ddl, rows, paths_in=()):
    """Rows as dicts against a schema; missing fields are NULL, path fields given as text."""
    from pyspark.sql.types import _parse_datatype_string

    full = _parse_datatype_string(ddl)
    defaults = {"seq": None, "project_id": "p"}
    loose = type(full)([f if f.name not in paths_in else type(f)(f.name, _parse_datatype_string("string")) for f in full.fields])
    data = []
    for i, r in enumerate(rows):
        row = {**defaults, "seq": i, **r}
        data.append(tuple(row.get(f.name, _empty(f)) for f in full.fields))
    df = spark.createDataFrame(data, loose)
    for p in paths_in:
        df = path(spark, df.withColumn(p, F.coalesce(F.col(p), F.lit(""))), p)
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in full.fields])


def _empty(field):
    kind = field.dataType.typeName()
    if kind == "array":
        return []
    if kind == "map":
        return {}
    if kind == "boolean":
        return False
    return None


def routers(spark, rows):
    return table(spark, schemas.ROUTERS, rows, ["prefix"])


def routes(spark, rows):
    return table(spark, schemas.ROUTES, rows, ["path"])


def mounts(spark, rows):
    return table(spark, schemas.MOUNTS, rows, ["prefix"])


def endpoints(spark, rows):
    df = table(spark, schemas.ENDPOINTS, rows, ["path"])
    return df.withColumn("id", paths.endpoint_id(F.col("method"), F.col("path")))


def param(name):
    return (name, None, False, None, None, [])


AUTH = ("bearer", None, None, None, [], None)
BODY = ("application/json", None, None, True)


def fastapi_project(spark):
    """The facts a small FastAPI project yields: two version mounts, a dynamic prefix, an
    orphan and a loop of registrations."""
    files = [
        "app/main.py", "app/auth.py", "app/config.py", "app/schemas.py", "app/api/admin.py", "app/api/dynamic.py",
        "app/api/items.py", "app/api/orphan.py", "app/api/users.py", "app/__init__.py", "app/api/__init__.py",
    ]
    api = "app/api/"
    facts = {
        "files": spark.createDataFrame([("p", f, "") for f in files], schemas.FILES),
        "routers": routers(
            spark,
            [
                {"module": "app/main.py", "name": "app", "is_app_root": True},
                {"module": api + "admin.py", "name": "router", "group": "admin"},
                {"module": api + "dynamic.py", "name": "router", "prefix": "/dynamic"},
                {"module": api + "items.py", "name": "router", "group": "items"},
                {"module": api + "orphan.py", "name": "router", "prefix": "/orphan"},
                {"module": api + "users.py", "name": "router", "prefix": "/users", "group": "users"},
            ],
        ),
        "mounts": mounts(
            spark,
            [
                {"parent_module": "app/main.py", "parent_name": "app", "child_module": "app/main.py", "child_name": n, "prefix": p}
                for n, p in [("users_router", "/api/v1"), ("items_router", "/v1"), ("items_router", "/v2"), ("admin.router", "/?settings.API_PREFIX")]
            ],
        ),
        "imports": table(
            spark,
            schemas.IMPORTS,
            [
                {"module": "app/main.py", "local_name": "FastAPI", "source": "fastapi", "original": "FastAPI", "level": 0},
                {"module": "app/main.py", "local_name": "admin", "source": "api", "original": "admin", "level": 1},
                {"module": "app/main.py", "local_name": "orphan", "source": "api", "original": "orphan", "level": 1},
                {"module": "app/main.py", "local_name": "items_router", "source": "api.items", "original": "router", "level": 1},
                {"module": "app/main.py", "local_name": "users_router", "source": "api.users", "original": "router", "level": 1},
                {"module": "app/main.py", "local_name": "settings", "source": "config", "original": "settings", "level": 1},
                {"module": api + "users.py", "local_name": "UserCreate", "source": "schemas", "original": "UserCreate", "level": 2},
            ],
        ),
        "exports": table(spark, schemas.EXPORTS, []),
        "routes": routes(
            spark,
            [
                {"router_module": "app/main.py", "router_name": "app", "methods": ["GET"], "path": "/health", "group": "meta", "line": 20},
                {"router_module": api + "admin.py", "router_name": "router", "methods": ["GET"], "path": "/stats", "line": 11},
                {"router_module": api + "dynamic.py", "router_name": "router", "methods": ["GET"], "path": "/?name", "line": 12},
                {"router_module": api + "items.py", "router_name": "router", "methods": ["GET"], "path": "/items", "line": 11, "query_params": [param("page")]},
                {"router_module": api + "items.py", "router_name": "router", "methods": ["GET", "PUT"], "path": "/items/{item_id}", "line": 17},
                {"router_module": api + "orphan.py", "router_name": "router", "methods": ["GET"], "path": "/forgotten", "line": 8},
                {"router_module": api + "users.py", "router_name": "router", "methods": ["GET"], "path": "/", "line": 17, "query_params": [param("limit"), param("search")]},
                {"router_module": api + "users.py", "router_name": "router", "methods": ["GET"], "path": "/{user_id}", "line": 26, "headers": [param("X-Trace-Id")]},
                {"router_module": api + "users.py", "router_name": "router", "methods": ["POST"], "path": "/", "line": 35, "body": BODY, "auth": AUTH},
                {"router_module": api + "users.py", "router_name": "router", "methods": ["DELETE"], "path": "/{user_id}", "line": 42, "auth": AUTH, "deprecated": True},
            ],
        ),
    }
    return facts
