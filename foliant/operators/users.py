"""Accounts: tokens, roles, claims and states. The protected account is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUPER = "super_admin"


def token_status(valid: Column, revoked: Column, disabled: Column) -> Column:
    """OK, TOKEN_REVOKED, USER_DISABLED or INVALID, as requests with such a token are answered; a null flag is false."""
    is_ = lambda c: F.coalesce(c, F.lit(False))
    return F.when(is_(revoked), F.lit("TOKEN_REVOKED")).when(is_(disabled), F.lit("USER_DISABLED")).when(~is_(valid), F.lit("INVALID")).otherwise(F.lit("OK"))


def is_admin(claims: Column) -> Column:
    """Whether a map of claims says admin is true, and nothing like it."""
    return F.coalesce(F.try_element_at(claims, F.lit("admin")) == "true", F.lit(False))


def me(users: DataFrame, super_email: str) -> DataFrame:
    """``users`` (uid, email, claims) with role, shown_email and granted: the super account is made admin where it isn't one, and is shown its role alone."""
    admin, special = is_admin(F.col("claims")), F.coalesce(F.lower("email") == super_email.lower(), F.lit(False))
    granted = special & ~admin
    return users.select("uid", F.when(admin | special, F.lit("admin")).otherwise(F.lit("user")).alias("role"),
        F.when(~granted, F.coalesce("email", F.lit(""))).alias("shown_email"), granted.alias("granted"))


def protected(users: DataFrame, email: str) -> Column:
    """Whether an account is the protected one, by claim or by email."""
    return F.coalesce((F.try_element_at("claims", F.lit("role")) == SUPER) | (F.col("email") == email), F.lit(False))


def set_admin(users: DataFrame, changes: DataFrame, email: str) -> DataFrame:
    """``users`` with status after ``changes`` (uid once each, admin): claims are overwritten, but for the protected account (403); unknown uids change nothing."""
    j = users.join(changes.select("uid", F.col("admin").alias("__admin")), "uid", "left")
    barred = protected(users, email)
    new = F.create_map(F.lit("admin"), F.col("__admin").cast("string"))
    asked = F.col("__admin").isNotNull()
    status = F.when(asked, F.when(barred, F.lit(403)).otherwise(F.lit(200)))
    return j.withColumn("status", status).withColumn("claims", F.when(asked & ~barred, new).otherwise(F.col("claims"))).drop("__admin")


def set_disabled(users: DataFrame, changes: DataFrame, email: str) -> DataFrame:
    """``users`` with status after ``changes`` (uid once each, disabled): the protected account can't be disabled (403), but enabled."""
    j = users.join(changes.select("uid", F.col("disabled").alias("__to")), "uid", "left")
    barred, asked = protected(users, email) & F.col("__to"), F.col("__to").isNotNull()
    status = F.when(asked, F.when(barred, F.lit(403)).otherwise(F.lit(200)))
    return j.withColumn("status", status).withColumn("disabled", F.when(asked & ~barred, F.col("__to")).otherwise(F.col("disabled"))).drop("__to")


def make_super(users: DataFrame, email: str) -> DataFrame:
    """``users`` with the claims of the super account added to those that it has."""
    claims = F.coalesce("claims", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(claims, lambda k, v: ~k.isin("role", "admin"))
    more = F.create_map(F.lit("role"), F.lit(SUPER), F.lit("admin"), F.lit("true"))
    return users.withColumn("claims", F.when(F.col("email") == email, F.map_concat(kept, more)).otherwise(F.col("claims")))


def listed(users: DataFrame, n: int = 1000) -> DataFrame:
    """The first ``n`` accounts by uid: uid, email, disabled, admin."""
    return users.orderBy("uid").limit(n).select("uid", "email", "disabled", is_admin(F.col("claims")).alias("admin"))


def reset_requests(users: DataFrame, link: Column) -> DataFrame:
    """uid, status, reset_link: ``link`` of the accounts with an email, 400 for the others."""
    known = F.coalesce(F.col("email") != "", F.lit(False))
    return users.select("uid", F.when(known, F.lit(200)).otherwise(F.lit(400)).alias("status"), F.when(known, link).alias("reset_link"))
