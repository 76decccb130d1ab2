"""Class-based views: what their base classes serve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apiquarry.functions import paths

P = "project_id"

# Methods a generic view serves, by base class.
GENERIC_METHODS = {
    "View": [],
    "TemplateView": ["GET"],
    "RedirectView": ["GET"],
    "ListView": ["GET"],
    "DetailView": ["GET"],
    "FormView": ["GET", "POST"],
    "CreateView": ["GET", "POST"],
    "UpdateView": ["GET", "POST"],
    "DeleteView": ["GET", "POST"],
    "APIView": [],
    "GenericAPIView": [],
    "ListAPIView": ["GET"],
    "CreateAPIView": ["POST"],
    "ListCreateAPIView": ["GET", "POST"],
    "RetrieveAPIView": ["GET"],
    "UpdateAPIView": ["PUT", "PATCH"],
    "DestroyAPIView": ["DELETE"],
    "RetrieveUpdateAPIView": ["GET", "PUT", "PATCH"],
    "RetrieveDestroyAPIView": ["GET", "DELETE"],
    "RetrieveUpdateDestroyAPIView": ["GET", "PUT", "PATCH", "DELETE"],
}
# Action → (method, needs a key).
VIEWSET_ACTIONS = {
    "list": ("GET", False),
    "create": ("POST", False),
    "retrieve": ("GET", True),
    "update": ("PUT", True),
    "partial_update": ("PATCH", True),
    "destroy": ("DELETE", True),
}
# Actions a view set base or mixin supplies.
VIEWSET_BASES = {
    "ModelViewSet": ["list", "create", "retrieve", "update", "partial_update", "destroy"],
    "ReadOnlyModelViewSet": ["list", "retrieve"],
    "ListModelMixin": ["list"],
    "CreateModelMixin": ["create"],
    "RetrieveModelMixin": ["retrieve"],
    "UpdateModelMixin": ["update", "partial_update"],
    "DestroyModelMixin": ["destroy"],
}


def expand_class_views(classes: DataFrame) -> DataFrame:
    """Routes of class-based views: project_id, module, name, action, method, path.

    ``classes`` has bases, own_methods and lookup. A view set serves the actions of its bases
    plus those it defines; another view the methods it defines, else those of its generic
    bases, else GET. The tables are fixed and small, so they are joined as broadcasts.
    """
    spark = classes.sparkSession
    action_rows = [(a, m, k, i) for i, (a, (m, k)) in enumerate(VIEWSET_ACTIONS.items())]
    actions = F.broadcast(spark.createDataFrame(action_rows, "action string, method string, keyed boolean, rank int"))
    supplied = F.broadcast(
        spark.createDataFrame([(b, a) for b, acts in VIEWSET_BASES.items() for a in acts], "base string, action string")
    )
    generic = F.broadcast(
        spark.createDataFrame([(b, m) for b, ms in GENERIC_METHODS.items() for m in ms], "base string, method string")
    )
    ids = [P, "module", "name"]
    is_viewset = F.exists("bases", lambda b: F.contains(b, F.lit("ViewSet")) | b.isin(list(VIEWSET_BASES)))
    view_method = lambda m: m.isin("get", "post", "put", "patch", "delete", "head", "options")
    looks = (
        is_viewset
        | F.exists("bases", lambda b: b.endswith("View"))
        | (F.size("own_methods") > 0)
    )
    views = classes.filter(looks).withColumn("_set", is_viewset)
    sets = views.filter("_set")
    offered = (
        sets.select(*ids, "lookup", F.explode("bases").alias("base")).join(supplied, "base").select(*ids, "lookup", "action")
        .unionByName(sets.select(*ids, "lookup", F.explode("own_methods").alias("action")))
        .distinct()
        .join(actions, "action")
    )
    key = paths.param(F.coalesce("lookup", F.lit("pk")))
    detail = paths.path_of(key, trailing_slash=True)
    listing = paths.path_of(trailing_slash=True)
    from_sets = offered.select(*ids, "action", "method", F.when(F.col("keyed"), detail).otherwise(listing).alias("path"))

    plain = views.filter("not _set")
    own = plain.select(*ids, F.explode(F.filter("own_methods", view_method)).alias("m")).select(*ids, F.upper("m").alias("method"))
    bare = plain.filter(~F.exists("own_methods", view_method))
    inherited = bare.select(*ids, F.explode("bases").alias("base")).join(generic, "base").select(*ids, "method")
    default = bare.select(*ids).join(inherited.select(*ids).distinct(), ids, "left_anti").withColumn("method", F.lit("GET"))
    from_views = own.unionByName(inherited).unionByName(default).distinct()
    return from_sets.unionByName(
        from_views.select(*ids, F.lit(None).cast("string").alias("action"), "method", paths.empty_path().alias("path"))
    )
