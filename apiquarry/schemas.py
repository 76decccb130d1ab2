"""Row types shared by the operators. Every table also carries ``project_id``."""

from __future__ import annotations

SEGMENT = (
    "struct<kind:string,value:string,name:string,ty:string,"
    "catch_all:boolean,optional:boolean,expr:string>"
)
PATH = f"struct<segments:array<{SEGMENT}>,trailing_slash:boolean>"
PARAM = (
    "struct<name:string,ty:string,required:boolean,default_json:string,"
    "description:string,enum_json:array<string>>"
)
BODY = "struct<content_type:string,schema_json:string,example_json:string,required:boolean>"
AUTH = (
    "struct<type:string,format:string,name:string,location:string,"
    "scopes:array<string>,hint:string>"
)
SOURCE = "struct<file:string,line:int,column:int>"
ORIGIN = "struct<source:string,framework:string,document:string>"
KEY_VALUES = "array<struct<key:string,value:string,enabled:boolean,description:string>>"
HEADERS = "array<struct<name:string,value:string>>"

ROUTERS = (
    f"project_id string, seq bigint, module string, name string, prefix {PATH}, `group` string,"
    "is_app_root boolean, implicit boolean, factory string, line int, column int"
)
ROUTES = (
    "project_id string, seq bigint, router_module string, router_name string, "
    f"methods array<string>, path {PATH}, query_params array<{PARAM}>, headers array<{PARAM}>, "
    f"body {BODY}, auth {AUTH}, summary string, description string, `group` string, "
    "deprecated boolean, handler_module string, handler_name string, line int, column int"
)
MOUNTS = (
    "project_id string, seq bigint, parent_module string, parent_name string, "
    f"child_module string, child_name string, prefix {PATH}, `group` string, auth {AUTH}, "
    "methods array<string>, replaces_child_prefix boolean, line int, column int"
)
IMPORTS = (
    "project_id string, seq bigint, module string, local_name string, source string, "
    "original string, level int"
)
EXPORTS = "project_id string, seq bigint, module string, exported string, local string"
FILES = "project_id string, path string, content string"
HANDLERS = (
    "project_id string, seq bigint, module string, name string, "
    f"query_params array<{PARAM}>, headers array<{PARAM}>, body {BODY}, auth {AUTH}, "
    "methods array<string>"
)
MODELS = (
    "project_id string, seq bigint, name string, module string, bases array<string>, "
    "fields array<struct<name:string,annotation:string,default_json:string,required:boolean>>"
)
ENDPOINTS = (
    f"project_id string, seq bigint, id string, method string, path {PATH}, "
    f"path_params array<{PARAM}>, query_params array<{PARAM}>, headers array<{PARAM}>, "
    f"body {BODY}, auth {AUTH}, source {SOURCE}, origin {ORIGIN}, `group` string, "
    "summary string, description string, confidence string, orphaned boolean, "
    "metadata map<string,string>"
)
