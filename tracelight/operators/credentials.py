"""Manifest stores, as JSON, to the credential fields of evidence rows: column expressions, no Python.

A store names an active manifest, and manifests name others as ingredients. Fields come from the active manifest and
from those that it reaches over ingredients whose own credentials do not fail, breadth first. Whatever of a store has
another type than expected counts as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import contains_any
from . import registries as R
from .verdict import EVIDENCE, binding_failed, signature_failed, synthid_vendors, validation_states

_STATUS = "struct<success:array<struct<code:string>>,informational:array<struct<code:string>>,failure:array<struct<code:string>>>"
_RESULTS = f"validation_results:struct<activeManifest:{_STATUS}>,validation_status:array<struct<code:string>>"
_ACTION = "struct<action:string,digitalSourceType:string,softwareAgent:struct<name:string>>"
_MANIFEST = (
    "struct<claim_generator:string,claim_generator_info:array<struct<name:string>>,signature_info:struct<issuer:string,common_name:string,certificate_issuer:string,time:string>,"
    f"ingredients:array<struct<active_manifest:string,{_RESULTS}>>,assertions:array<struct<label:string,data:struct<alg:string,actions:array<{_ACTION}>>>>>"
)
STORE = f"struct<active_manifest:string,manifests:map<string,{_MANIFEST}>,validation_state:string,error:string,{_RESULTS}>"
# Action names that lose their prefix, and texts of the source types.
ACTIONS = ("created", "converted", "edited", "filtered", "cropped", "resized", "opened", "placed", "watermarked.unbound")
GENERATED, ENHANCED, PROCEDURAL = "trainedAlgorithmicMedia (AI-generated)", "compositeWithTrainedAlgorithmicMedia (AI-enhanced)", "algorithmicMedia"


def _texts(values: Column) -> Column:
    """The non-null, non-empty texts of an array; an absent array is empty."""
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def status_codes(of: Column) -> Column:
    """struct(successes, informationals, failures): the codes of a store's or an ingredient's active credential, in order.

    Older readers have only a flat list of what did not succeed; its codes are failures, if there is nothing else.
    """
    active = of["validation_results"]["activeManifest"]
    good, told, bad = (_texts(active[k]["code"]) for k in ("success", "informational", "failure"))
    flat = F.when(F.size(good) + F.size(told) + F.size(bad) == 0, _texts(of["validation_status"]["code"])).otherwise(bad)
    return F.struct(good.alias("successes"), told.alias("informationals"), flat.alias("failures"))


def credential_failed(of: Column) -> Column:
    """Whether the binding or the signature of a store's or an ingredient's own credential fails."""
    codes = status_codes(of)["failures"]
    return binding_failed(codes) | signature_failed(codes)


def chain(store: Column) -> Column:
    """The labels of the active manifest and of those that usable ingredients lead to, breadth first; each once."""
    manifests = F.coalesce(store["manifests"], F.create_map().cast(f"map<string,{_MANIFEST}>"))
    none = F.array().cast("array<string>")

    def led_to(label: Column) -> Column:
        parts = F.coalesce(F.element_at(manifests, label)["ingredients"], F.array().cast(f"array<struct<active_manifest:string,{_RESULTS}>>"))
        return F.transform(F.filter(parts, lambda x: x["active_manifest"].isNotNull() & ~credential_failed(x)), lambda x: x["active_manifest"])

    first = F.when(store["active_manifest"].isNotNull(), F.array(store["active_manifest"])).otherwise(none)
    # each step takes one level more; there are not more levels than manifests
    reached = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(manifests), F.lit(1))), first, lambda labels, _: F.array_distinct(F.concat(labels, F.flatten(F.transform(labels, led_to)))))
    return F.filter(reached, lambda label: F.element_at(manifests, label).isNotNull())


def _named(texts: Column, registry) -> Column:
    """The labels of a registry whose tokens any of the texts has, text by text, each in registry order; each once."""
    of = lambda t: F.array_compact(F.array(*(F.when(F.contains(t, F.lit(token)), F.lit(label)) for token, label in registry)))
    return F.array_distinct(F.flatten(F.transform(_texts(texts), of)))


def _joined(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.array_join(values, ", "))


def fields_of(store: Column, manifests: Column) -> Column:
    """struct of what a parsed store and the manifests of its chain say: the ``c2pa`` fields of evidence rows, and actions, watermarked,
    soft_binding, synthid, time."""
    active = F.element_at(store["manifests"], store["active_manifest"])
    assertions = F.flatten(F.transform(manifests, lambda m: F.coalesce(m["assertions"], F.array().cast("array<struct<label:string,data:struct<alg:string,actions:array<" + _ACTION + ">>>>"))))
    starting = lambda prefix: F.filter(assertions, lambda a: F.startswith(F.coalesce(a["label"], F.lit("")), F.lit(prefix)))
    actions = F.flatten(F.transform(starting("c2pa.actions"), lambda a: F.coalesce(a["data"]["actions"], F.array().cast(f"array<{_ACTION}>"))))
    signed = F.flatten(F.transform(manifests, lambda m: F.array(m["signature_info"]["issuer"], m["signature_info"]["common_name"], m["signature_info"]["certificate_issuer"])))
    claims = F.flatten(F.transform(manifests, lambda m: F.concat(F.array(m["claim_generator"]), F.coalesce(m["claim_generator_info"]["name"], F.array().cast("array<string>")))))
    agents = F.transform(actions, lambda a: a["softwareAgent"]["name"])
    names = F.transform(_texts(F.transform(actions, lambda a: a["action"])), lambda a: F.when(F.startswith(a, F.lit("c2pa.")), F.substr(a, F.lit(6))).otherwise(a))
    kinds = _texts(F.transform(actions, lambda a: a["digitalSourceType"]))
    composite = lambda k: F.contains(k, F.lit("compositeWithTrainedAlgorithmicMedia"))
    generated = F.exists(kinds, lambda k: F.contains(k, F.lit("trainedAlgorithmicMedia")) & ~composite(k))
    enhanced, procedural = F.exists(kinds, composite), F.exists(kinds, lambda k: F.contains(k, F.lit("algorithmicMedia")))
    printable = lambda t: F.when(t.rlike(r"^[^\p{C}\p{Zl}\p{Zp}]+$"), t)
    generator = F.coalesce(printable(active["claim_generator"]), printable(F.get(active["claim_generator_info"]["name"], F.lit(0))))
    codes = status_codes(store)
    states = validation_states(codes["successes"], codes["failures"])
    kind = F.when(generated, F.lit("generated")).when(enhanced, F.lit("enhanced"))
    # a vendor's SynthID follows from what the chain's manifests say, whatever else the store holds
    said = F.to_json(manifests).cast("binary")
    marked = F.exists(names, lambda n: F.startswith(n, F.lit("watermarked")))
    bindings = F.array_join(_texts(F.transform(starting("c2pa.soft-binding"), lambda a: a["data"]["alg"])), "\n")
    found = [F.when(F.contains(bindings, F.lit(t)), F.lit(label)) for t, label in R.SOFT_BINDINGS]
    return F.struct(
        F.lit(True).alias("present"),
        _joined(_named(signed, R.ISSUER_NAMES)).alias("issuer"),
        generator.alias("claim_generator"),
        _joined(F.array_distinct(F.concat(_named(claims, R.AI_TOOLS), _named(agents, R.AI_TOOLS)))).alias("ai_tool"),
        F.when(generated, F.lit(GENERATED)).when(enhanced, F.lit(ENHANCED)).when(procedural, F.lit(PROCEDURAL)).alias("source_type"),
        kind.alias("ai_source_kind"),
        (F.size(_named(claims, R.AI_TOOLS)) > 0).alias("identity_ai"),
        *(states[f].alias(f) for f in ("integrity", "signature", "signer_trust", "signer_validity")),
        F.array_distinct(F.concat(codes["successes"], codes["informationals"], codes["failures"])).alias("codes"),
        _joined(F.array_distinct(names)).alias("actions"),
        marked.alias("watermarked"),
        _joined(F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))).alias("soft_binding"),
        F.when(kind.isNotNull(), _joined(synthid_vendors(said, marked))).alias("synthid"),
        active["signature_info"]["time"].alias("time"),
    )


def credentials(stores: DataFrame, key: str = "path", store: str = "store") -> DataFrame:
    """(key, c2pa, actions, watermarked, soft_binding, synthid, time) of rows (key, manifest store as JSON).

    A text that is no JSON object, an empty one or one with an error gives a null ``c2pa``.
    """
    made = F.from_json(F.col(store), STORE)
    of = lambda f: F.col(f"m.{f}")
    usable = of("error").isNull() & (of("active_manifest").isNotNull() | of("manifests").isNotNull() | of("validation_results").isNotNull() | of("validation_status").isNotNull())
    # in steps, so that the store is parsed and its chain is walked once a row, however many fields read them
    rows = stores.select(key, made.alias("m")).select(key, F.when(usable, F.col("m")).alias("s")).withColumn("labels", chain(F.col("s")))
    rows = rows.withColumn("chain", F.transform("labels", lambda label: F.element_at(F.col("s.manifests"), label)))
    rows = rows.select(key, F.when(F.col("s").isNotNull(), fields_of(F.col("s"), F.col("chain"))).alias("f"))
    wanted = stores.sparkSession.createDataFrame([], EVIDENCE).schema["c2pa"].dataType
    c2pa = F.when(F.col("f").isNotNull(), F.struct(*(F.col(f"f.{f.name}").cast(f.dataType).alias(f.name) for f in wanted)))
    return rows.select(key, c2pa.alias("c2pa"), *(F.col(f"f.{n}").alias(n) for n in ("actions", "watermarked", "soft_binding", "synthid", "time")))


def with_credentials(evidence: DataFrame, stores: DataFrame) -> DataFrame:
    """Evidence rows with the fields of their manifest stores (path, store); rows without a store keep what they have."""
    found = credentials(stores).select("path", F.col("c2pa").alias("_c2pa"), F.col("soft_binding").alias("_binding"), F.col("synthid").alias("_synthid"))
    both = evidence.join(found, "path", "left")
    named = {"c2pa": F.coalesce("_c2pa", "c2pa"), "soft_binding": F.coalesce("_binding", "soft_binding"), "synthid": F.coalesce("_synthid", "synthid")}
    return both.select(*(named.get(c, F.col(c)).alias(c) for c in evidence.columns))


# Products of apps that write their own disclosure.
APP_PRODUCTS = (("doubao", "ByteDance Doubao"), ("xinghui", "ByteDance Xinghui"), ("dreamina", "ByteDance Dreamina"), ("dreamina_oversea", "ByteDance Dreamina"))


def app_evidence(text: Column) -> Column:
    """struct(provenance, generator): the product that exported a file, and what an app's own JSON says of AI origin; each can be NULL.

    The product alone does not say that the pixels were generated.
    """
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit('\\"'), F.lit('"'))
    values = lambda key: F.transform(F.regexp_extract_all(plain, F.lit(rf'(?i)"{key}"\s*:\s*"([a-z0-9_]+)"'), F.lit(1)), F.lower)
    products = values("product")
    table = F.create_map(*(F.lit(x) for kv in APP_PRODUCTS for x in kv))
    known = F.filter(products, lambda p: p.isin(*(p for p, _ in APP_PRODUCTS)))
    made = F.arrays_overlap(products, F.array(F.lit("dreamina"), F.lit("dreamina_oversea"))) & F.array_contains(values("exportType"), "generation")
    told = F.contains(F.lower(plain), F.lit('"aigc_info"'))
    aweme = F.array_contains(products, "aweme") & plain.rlike(r'(?i)"aigc_type"\s*:\s*1(?=\s*[,}])')
    generator = F.when(made, "ByteDance Dreamina").when(told & aweme, "ByteDance Aweme AI").when(told & plain.rlike(r'(?i)"aigc_label_type"\s*:\s*[12](?=\s*[,}])'), "Embedded app AIGC disclosure")
    return F.struct(F.element_at(table, F.get(known, F.lit(0))).alias("provenance"), generator.alias("generator"))


def is_ai_value(value: Column, tokens) -> Column:
    """Whether a metadata value names a generator or holds an app's disclosure."""
    app = app_evidence(value)
    return app["provenance"].isNotNull() | app["generator"].isNotNull() | contains_any(F.lower(F.coalesce(value, F.lit(""))), tokens)


