"""HTTP status and adapter error definitions, joined as small fixed dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.guards import LimitError, refuse_when

CATALOGUE_VERSION = "iana-2025-09-15"

# The public IANA status code registry of that date (code, name, reference).
STATUSES = [
    (100, "Continue", "[RFC9110, Section 15.2.1]"),
    (101, "Switching Protocols", "[RFC9110, Section 15.2.2]"),
    (102, "Processing", "[RFC2518]"),
    (103, "Early Hints", "[RFC8297]"),
    (
        104,
        "Upload Resumption Supported (TEMPORARY - registered 2024-11-13, extension registered 2025-09-15, "
        "expires 2026-11-13)",
        "[draft-ietf-httpbis-resumable-upload-05]",
    ),
    (200, "OK", "[RFC9110, Section 15.3.1]"),
    (201, "Created", "[RFC9110, Section 15.3.2]"),
    (202, "Accepted", "[RFC9110, Section 15.3.3]"),
    (203, "Non-Authoritative Information", "[RFC9110, Section 15.3.4]"),
    (204, "No Content", "[RFC9110, Section 15.3.5]"),
    (205, "Reset Content", "[RFC9110, Section 15.3.6]"),
    (206, "Partial Content", "[RFC9110, Section 15.3.7]"),
    (207, "Multi-Status", "[RFC4918]"),
    (208, "Already Reported", "[RFC5842]"),
    (226, "IM Used", "[RFC3229]"),
    (300, "Multiple Choices", "[RFC9110, Section 15.4.1]"),
    (301, "Moved Permanently", "[RFC9110, Section 15.4.2]"),
    (302, "Found", "[RFC9110, Section 15.4.3]"),
    (303, "See Other", "[RFC9110, Section 15.4.4]"),
    (304, "Not Modified", "[RFC9110, Section 15.4.5]"),
    (305, "Use Proxy", "[RFC9110, Section 15.4.6]"),
    (306, "(Unused)", "[RFC9110, Section 15.4.7]"),
    (307, "Temporary Redirect", "[RFC9110, Section 15.4.8]"),
    (308, "Permanent Redirect", "[RFC9110, Section 15.4.9]"),
    (400, "Bad Request", "[RFC9110, Section 15.5.1]"),
    (401, "Unauthorized", "[RFC9110, Section 15.5.2]"),
    (402, "Payment Required", "[RFC9110, Section 15.5.3]"),
    (403, "Forbidden", "[RFC9110, Section 15.5.4]"),
    (404, "Not Found", "[RFC9110, Section 15.5.5]"),
    (405, "Method Not Allowed", "[RFC9110, Section 15.5.6]"),
    (406, "Not Acceptable", "[RFC9110, Section 15.5.7]"),
    (407, "Proxy Authentication Required", "[RFC9110, Section 15.5.8]"),
    (408, "Request Timeout", "[RFC9110, Section 15.5.9]"),
    (409, "Conflict", "[RFC9110, Section 15.5.10]"),
    (410, "Gone", "[RFC9110, Section 15.5.11]"),
    (411, "Length Required", "[RFC9110, Section 15.5.12]"),
    (412, "Precondition Failed", "[RFC9110, Section 15.5.13]"),
    (413, "Content Too Large", "[RFC9110, Section 15.5.14]"),
    (414, "URI Too Long", "[RFC9110, Section 15.5.15]"),
    (415, "Unsupported Media Type", "[RFC9110, Section 15.5.16]"),
    (416, "Range Not Satisfiable", "[RFC9110, Section 15.5.17]"),
    (417, "Expectation Failed", "[RFC9110, Section 15.5.18]"),
    (418, "(Unused)", "[RFC9110, Section 15.5.19]"),
    (421, "Misdirected Request", "[RFC9110, Section 15.5.20]"),
    (422, "Unprocessable Content", "[RFC9110, Section 15.5.21]"),
    (423, "Locked", "[RFC4918]"),
    (424, "Failed Dependency", "[RFC4918]"),
    (425, "Too Early", "[RFC8470]"),
    (426, "Upgrade Required", "[RFC9110, Section 15.5.22]"),
    (428, "Precondition Required", "[RFC6585]"),
    (429, "Too Many Requests", "[RFC6585]"),
    (431, "Request Header Fields Too Large", "[RFC6585]"),
    (451, "Unavailable For Legal Reasons", "[RFC7725]"),
    (500, "Internal Server Error", "[RFC9110, Section 15.6.1]"),
    (501, "Not Implemented", "[RFC9110, Section 15.6.2]"),
    (502, "Bad Gateway", "[RFC9110, Section 15.6.3]"),
    (503, "Service Unavailable", "[RFC9110, Section 15.6.4]"),
    (504, "Gateway Timeout", "[RFC9110, Section 15.6.5]"),
    (505, "HTTP Version Not Supported", "[RFC9110, Section 15.6.6]"),
    (506, "Variant Also Negotiates", "[RFC2295]"),
    (507, "Insufficient Storage", "[RFC4918]"),
    (508, "Loop Detected", "[RFC5842]"),
    (510, "Not Extended (OBSOLETED)", "[RFC2774][Status change of HTTP experiments to Historic]"),
    (511, "Network Authentication Required", "[RFC6585]"),
]

# Adapter error codes and their categories.
ERRORS = [
    ("HTTP001", "request"),
    ("HTTP002", "credential"),
    ("HTTP003", "transport"),
    ("HTTP004", "timeout"),
    ("HTTP005", "redirect"),
    ("HTTP006", "size"),
    ("HTTP007", "response"),
    ("HTTP008", "status"),
    ("HTTP009", "internal"),
    ("HTTP_TRANSIENT", "transient-hint"),
    ("HTTPD001", "domain-input"),
    ("HTTPD002", "domain-limit"),
]


def _class_of(code: Column) -> Column:
    hundreds = F.floor(code / 100)
    return (
        F.when(hundreds == 1, "informational")
        .when(hundreds == 2, "success")
        .when(hundreds == 3, "redirection")
        .when(hundreds == 4, "client-error")
        .otherwise("server-error")
    )


def _registration_of(name: Column) -> Column:
    return (
        F.when(name.isNull(), "unassigned")
        .when(name.contains("TEMPORARY"), "temporary")
        .when(name.contains("Unused"), "unused")
        .when(name.contains("OBSOLETED"), "obsolete")
        .otherwise("registered")
    )


def catalogue(spark: SparkSession, which: str) -> DataFrame:
    """The bundled ``statuses`` or ``errors``: fixed tables of under a hundred rows."""
    if which == "statuses":
        df = spark.createDataFrame(STATUSES, "code int, name string, reference string")
        return df.select("code", "name", "reference").withColumns(
            {"class": _class_of(F.col("code")), "registration": _registration_of(F.col("name"))}
        )
    if which == "errors":
        return spark.createDataFrame(ERRORS, "code string, category string")
    raise LimitError("catalogue must be statuses or errors")


def code_lookup(df: DataFrame, code: str) -> DataFrame:
    """Add the definition of an Int status column; codes outside 100..599 fail, unlisted ones are unassigned."""
    known = catalogue(df.sparkSession, "statuses").select(F.col("code").alias("_code"), "name", "reference")
    checked = refuse_when(~F.col(code).between(100, 599), F.col(code), "status must be from 100 to 599")
    joined = df.withColumn(code, checked).join(F.broadcast(known), F.col(code) == F.col("_code"), "left")
    return joined.select(
        *df.columns,
        F.coalesce("name", F.lit("Unassigned")).alias("name"),
        _class_of(F.col(code)).alias("class"),
        _registration_of(F.col("name")).alias("registration"),
        F.coalesce("reference", F.lit("")).alias("reference"),
        F.lit(CATALOGUE_VERSION).alias("catalogue_version"),
    )


def error_lookup(df: DataFrame, code: str) -> DataFrame:
    """Add whether an adapter error code is known and its category."""
    errors = catalogue(df.sparkSession, "errors").select(F.col("code").alias("_code"), "category")
    bad = ~F.col(code).rlike(r"\A[A-Za-z0-9_]{1,64}\z")
    checked = refuse_when(bad, F.col(code), "error code needs 1 to 64 letters, digits or underscores")
    joined = df.withColumn(code, checked).join(F.broadcast(errors), F.col(code) == F.col("_code"), "left")
    detail = F.col(code).rlike(r"\AHTTP_STATUS_[1-5][0-9]{2}\z")
    return joined.select(
        *df.columns,
        (F.col("_code").isNotNull() | detail).alias("known"),
        F.coalesce("category", F.when(detail, "status-detail").otherwise("unknown")).alias("category"),
    )
