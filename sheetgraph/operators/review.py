"""Review patches, lifecycle, jobs and the credit ledger as histories."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetgraph.operators.cleaning import FIELDS
from sheetgraph.operators.netlist import PIN_TYPES

# Transitions of a job's state, implied roles, editable text fields.
TRANSITIONS = {
    "extracted": {"edit": "edited", "review": "reviewed", "revoke": "revoked"},
    "edited": {"edit": "edited", "review": "reviewed", "revoke": "revoked"},
    "reviewed": {"edit": "edited", "review": "reviewed", "approve": "approved", "revoke": "revoked"},
    "approved": {"approve": "approved", "review": "reviewed", "edit": "edited", "publish": "published", "revoke": "revoked"},
    "published": {"publish": "published", "approve": "published", "edit": "edited", "revoke": "revoked"},
}
IMPLIES = {"publisher": ("publisher", "reviewer", "editor", "viewer"), "reviewer": ("reviewer", "editor", "viewer"), "editor": ("editor", "viewer"), "viewer": ("viewer",)}
TEXT_FIELDS = ("part/mpn", "part/manufacturer", "part/title", "pins/name", "pins/number", "pins/description", "figures/title")
#: Further numbers: (least, most, whole, may be null).
MORE_FIELDS = {"pin_count": (2, 256, True, False), "lead_width": (0.05, 5, False, True), "ep_length": (0.1, 60, False, True), "ep_width": (0.1, 60, False, True)}
FIGURE_KINDS = ("block_diagram", "application", "pin_configuration", "package_outline")
EVIDENCE_KEYS = ("page", "bbox", "quotedText", "documentSha256", "sourceType", "confidence", "note")


def is_box(box: Column) -> Column:
    """Four numbers from 0 to 1, the first two below the others."""
    inside = F.forall(box, lambda x: x.isNotNull() & (x >= 0) & (x <= 1))
    return F.coalesce((F.size(box) == 4) & inside & (F.get(box, F.lit(0)) < F.get(box, F.lit(2))) & (F.get(box, F.lit(1)) < F.get(box, F.lit(3))), F.lit(False))


def is_count(n: Column) -> Column:
    return F.coalesce((n >= 1) & (n == F.floor(n)), F.lit(False))


def evidence_error(evidence: Column) -> Column:
    """What is wrong with an edit's evidence, a JSON object; null if there is none or nothing is wrong."""
    keys = F.json_object_keys(evidence)
    ev = F.from_json(evidence, "page double, bbox array<double>")
    return (
        F.when(evidence.isNotNull() & keys.isNull(), "evidence_not_an_object")
        .when(F.size(F.array_except(keys, F.array(*map(F.lit, EVIDENCE_KEYS)))) > 0, "evidence_unknown_field")
        .when(F.array_contains(keys, "page") & ~is_count(ev["page"]), "evidence_page")
        .when(F.array_contains(keys, "bbox") & ~is_box(ev["bbox"]), "evidence_bbox")
    )


def patch_validate(edits: DataFrame) -> DataFrame:
    """(event_id, job_id, path, value, error): what is wrong with an edit, or null. Nothing is clamped.

    edits: (event_id, job_id, path, value, reason, evidence); a page, quote or note as evidence stands for a reason.
    """
    spec = {k: (v[0], v[1], False, False) for k, v in FIELDS.items()} | MORE_FIELDS
    row = lambda v: F.struct(F.lit(float(v[0])).alias("least"), F.lit(float(v[1])).alias("most"), F.lit(v[2]).alias("whole"), F.lit(v[3]).alias("nullable"))
    ranges = F.create_map(*[x for k, v in spec.items() for x in (F.lit(f"packages/{k}"), row(v))])
    path, value = F.col("path"), F.col("value")
    r, n = F.try_element_at(ranges, path), F.expr("try_cast(value as double)")
    known = r.isNotNull() | path.isin(*TEXT_FIELDS, "pins/type", "figures/bbox", "figures/kind", "figures/page", "figures/confirmed")
    said = F.from_json("evidence", "page double, quotedText string, note string")
    confirmed = (said["page"] > 0) | (F.coalesce(said["quotedText"], F.lit("")) != "") | (F.coalesce(said["note"], F.lit("")) != "")
    number = r.isNotNull() & ~(value.isNull() & r["nullable"])
    finite = n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))
    error = (
        F.when(~known, "unknown_field")
        .when(evidence_error(F.col("evidence")).isNotNull(), evidence_error(F.col("evidence")))
        .when((F.trim(F.coalesce("reason", F.lit(""))) == "") & ~F.coalesce(confirmed, F.lit(False)), "reason_missing")
        .when(number & ~finite, "not_a_number")
        .when(number & r["whole"] & (n != F.floor(n)), "not_whole")
        .when(number & ((n < r["least"]) | (n > r["most"])), "out_of_range")
        .when((path == "pins/type") & ~F.coalesce(value.isin(*PIN_TYPES), F.lit(False)), "unknown_type")
        .when((path == "figures/kind") & ~F.coalesce(value.isin(*FIGURE_KINDS), F.lit(False)), "unknown_kind")
        .when((path == "figures/confirmed") & ~F.coalesce(value.isin("true", "false"), F.lit(False)), "not_a_boolean")
        .when((path == "figures/page") & ~is_count(n), "not_a_page")
        .when((path == "figures/bbox") & ~is_box(F.from_json(value, "array<double>")), "not_a_box")
    )
    return edits.select("event_id", "job_id", "path", "value", error.alias("error"))


def accepted(checked: DataFrame, batch: str = "job_id") -> DataFrame:
    """Edits of the batches without any error: one error rejects a batch whole."""
    bad = checked.where("error is not null").select(batch).distinct()
    return checked.join(bad, batch, "left_anti")


def patch_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, field, op, before, after) of two long tables (id, field, value); unchanged values emit nothing."""
    o = old.select("id", "field", F.col("value").alias("before"), F.lit(1).alias("o"))
    n = new.select("id", "field", F.col("value").alias("after"), F.lit(1).alias("n"))
    both = o.join(n, ["id", "field"], "full").where(~F.col("before").eqNullSafe(F.col("after")) | F.col("o").isNull() | F.col("n").isNull())
    return both.select("id", "field", F.when(F.col("o").isNull(), "add").when(F.col("n").isNull(), "remove").otherwise("update").alias("op"), "before", "after")


def patch_apply(old: DataFrame, edits: DataFrame) -> DataFrame:
    """The long table after the edits (id, field, op, value, seq, reviewer, reason, page); the latest edit of a field wins and
    leaves its reviewer's anchor: (id, field, value, reviewed, source_type, reviewer, reason, page)."""
    said = F.struct("op", "value", "reviewer", "reason", "page")
    last = edits.groupBy("id", "field").agg(F.max_by(said, "seq").alias("e"))
    out = old.join(last, ["id", "field"], "full").where("e is null or e.op <> 'remove'")
    hit = F.col("e").isNotNull()
    return out.select(
        "id", "field", F.when(hit, F.col("e.value")).otherwise(F.col("value")).alias("value"), hit.alias("reviewed"), F.when(hit, "reviewer").alias("source_type"),
        "e.reviewer", F.when(hit, F.coalesce("e.reason", F.lit(""))).alias("reason"), "e.page",
    )


def change_log(old: DataFrame, edits: DataFrame) -> DataFrame:
    """Before and after of each field that the edits change."""
    new = patch_apply(old, edits).select("id", "field", "value")
    return patch_diff(old, new)


def asset_keys(pinsets: DataFrame, packages: DataFrame, figures: DataFrame) -> DataFrame:
    """(kind, key): symbol per pin set, footprint and 3D model per package, figure per figure. Inputs: one id column."""
    key = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.concat_ws(":", F.lit(kind), F.col(df.columns[0]).cast("string")).alias("key"))
    return key(pinsets, "symbol").union(key(packages, "footprint")).union(key(packages, "model3d")).union(key(figures, "figure"))


def lifecycle_step(state: str, action: str) -> str | None:
    """The state after an action, or None if it is not allowed."""
    return TRANSITIONS.get(state, {}).get(action)


def lifecycle_state(events: DataFrame) -> DataFrame:
    """(job_id, state, applied, rejected) after a job's actions in order; an action that is not allowed changes nothing."""
    table = F.create_map(*[F.lit(x) for s, m in TRANSITIONS.items() for a, to in m.items() for x in (f"{s}>{a}", to)])
    jobs = events.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "action"))).alias("e"))

    def step(acc: Column, x: Column) -> Column:
        to = F.try_element_at(table, F.concat(acc["state"], F.lit(">"), x["action"]))
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), (acc["applied"] + F.when(to.isNotNull(), 1).otherwise(0)).alias("applied"), (acc["rejected"] + F.when(to.isNull(), 1).otherwise(0)).alias("rejected"))

    start = F.struct(F.lit("extracted").alias("state"), F.lit(0).alias("applied"), F.lit(0).alias("rejected"))
    return jobs.select("job_id", F.aggregate("e", start, step).alias("s")).select("job_id", "s.*")


def approvals_invalidated(changes: DataFrame, packages: DataFrame, approvals: DataFrame) -> DataFrame:
    """(job_id, key): approvals that changed paths make lapse.

    changes: (job_id, path), packages: (job_id, package_id, pinset_id), approvals: (job_id, key). A package's change touches
    its footprint and 3D model, and a change of its pin set every symbol; a pin set's its symbol and the packages that
    use it; a figure's itself; one of the part everything.
    """
    kind, ident = F.regexp_extract("path", r"^(\w+)", 1), F.regexp_extract("path", r"^\w+\[([^\]]+)\]", 1)
    c = changes.select("job_id", kind.alias("kind"), ident.alias("id"), F.col("path").endswith(".pinset_id").alias("moved")).distinct()
    pk = packages.select("job_id", F.col("package_id").cast("string").alias("package"), F.col("pinset_id").cast("string").alias("id"))
    users = c.where("kind = 'pinsets' and id <> ''").join(pk, ["job_id", "id"]).select("job_id", F.lit("packages").alias("kind"), F.col("package").alias("id"))
    kinds = F.create_map(*map(F.lit, ("packages", "footprint model3d", "pinsets", "symbol", "figures", "figure")))
    named = c.where("id <> ''").select("job_id", "kind", "id").union(users)
    named = named.select("job_id", F.explode(F.split(F.try_element_at(kinds, F.col("kind")), " ")).alias("asset"), "id")
    named = named.select("job_id", F.concat_ws(":", "asset", "id").alias("key"))
    whole = c.where("kind = 'part'").select("job_id", F.lit("").alias("prefix"))
    symbols = c.where("kind = 'packages' and moved").select("job_id", F.lit("symbol:").alias("prefix"))
    broad = whole.union(symbols).distinct()
    lapsed = approvals.join(named, ["job_id", "key"], "left_semi").select("job_id", "key")
    return lapsed.union(approvals.join(broad, "job_id").where(F.col("key").startswith(F.col("prefix"))).select("job_id", "key")).distinct()


def approval_valid(approvals: DataFrame, current: DataFrame) -> DataFrame:
    """Whether a key's approval is of the current revision, and of the current hash where one is known."""
    out = current.join(approvals.select("key", F.col("revision").alias("a_rev"), F.col("hash").alias("a_hash")), "key", "left")
    ok = F.col("a_rev").isNotNull() & (F.col("a_rev") == F.col("revision")) & (F.col("hash").isNull() | F.col("a_hash").eqNullSafe(F.col("hash")))
    return out.select("key", F.coalesce(ok, F.lit(False)).alias("valid"))


def asset_versions(keys: DataFrame, published: DataFrame) -> DataFrame:
    """(job_id, version, revision, approved, conflict): version rows `key@rN` of a job, and whether one is not unique.

    keys: (job_id, key), published: (job_id, key, revision, approved).
    """
    out = published.join(keys, ["job_id", "key"], "left_semi").groupBy("job_id", "key", "revision").agg(F.count("*").alias("n"), F.bool_and("approved").alias("approved"))
    return out.select("job_id", F.concat(F.col("key"), F.lit("@r"), F.col("revision").cast("string")).alias("version"), "revision", "approved", (F.col("n") > 1).alias("conflict"))


def asset_fork(versions: DataFrame, forks: DataFrame) -> DataFrame:
    """Versions with those of forked jobs (job_id, new_job_id) again under the new job, which has to approve them anew."""
    copies = versions.join(forks, "job_id").select(F.col("new_job_id").alias("job_id"), "version", "revision", F.lit(False).alias("approved"), "conflict")
    return versions.union(copies)


def asset_hashes(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """(job_id, key, hash, files): a hash over the own files of each asset key, and over all keys of a job as its `revision`.

    Hashes roll up from files to keys to the revision, so a file that changes moves its own keys and the revision, and nothing
    else. Files belong to a key by kind and owner: a symbol's to its pin set, those of a footprint or model to its package, an
    image to its figure. A key without files has the hash of `instead` (a figure's box), or of the empty text.
    manifest: (job_id, kind, owner, path, sha); keys: (job_id, kind, owner, key, instead). Rows that come again count once.
    """
    own = ["job_id", "kind", "owner"]
    files = manifest.groupBy(*own, "path", "sha").agg(F.first(F.concat_ws(" ", "path", "sha")).alias("line"))
    files = files.groupBy(*own).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text"), F.count("*").alias("files"))
    one = keys.groupBy(*own, "key").agg(F.min("instead").alias("instead")).join(files, own, "left")
    one = one.select("job_id", "key", F.sha2(F.coalesce("text", "instead", F.lit("")), 256).alias("hash"), F.coalesce("files", F.lit(0)).alias("files"))
    line = F.concat_ws(" ", "key", "hash")
    whole = one.groupBy("job_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("hash"), F.sum("files").alias("files"))
    return one.union(whole.select("job_id", F.lit("revision"), "hash", "files"))


def can_publish(assets: DataFrame) -> DataFrame:
    """approved, promotable and a publisher at work."""
    return assets.select("key", (F.col("approved") & F.col("promotable") & F.col("publisher")).alias("can_publish"))


def role_access(requests: DataFrame) -> DataFrame:
    """(request_id, tenant, user, role, job_tenant, owner, need) -> allowed, and why not."""
    implied = F.create_map(*[x for k, v in IMPLIES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    roles = F.coalesce(F.try_element_at(implied, F.lower("role")), F.array(F.lit("viewer")))
    elevated = F.array_contains(roles, "reviewer")
    why = F.when(F.col("tenant") != F.col("job_tenant"), "tenant_mismatch").when((F.col("user") != F.col("owner")) & ~elevated, "not_job_owner").when(~F.array_contains(roles, F.col("need")), "insufficient_role").otherwise("ok")
    return requests.select("request_id", why.alias("result"))


def revision_conflicts(writes: DataFrame) -> DataFrame:
    """Of the writes to a job that expect one revision only the first succeeds."""
    k = F.row_number().over(W.partitionBy("job_id", "expected_revision").orderBy("ts", "event_id"))
    return writes.select("event_id", "job_id", "expected_revision", F.when(k == 1, "ok").otherwise("revision_conflict").alias("result"))


def scope_key() -> Column:
    """What a request's key holds for; null without a key."""
    parts = F.concat_ws("\0", F.col("tenant").cast("string"), F.col("owner").cast("string"), "operation", F.col("doc").cast("string"), F.col("key").cast("string"))
    return F.when(F.col("key").isNotNull(), F.sha2(parts, 256))


def idempotency_scope(requests: DataFrame, ttl_seconds: int, revoked: DataFrame | None = None) -> DataFrame:
    """(event_id, scope, job, reused): the job that each request gets. A request makes a job unless its scope has one that is
    neither expired (ttl_seconds after it was made; the last instant counts) nor revoked; without a key it always makes one.

    revoked: (scope, ts) of revocations, which clear the scope. A scope's requests stream through a task in order of time, and only its
    job is held.
    """
    made = requests.select(scope_key().alias("scope"), "ts", "event_id", F.lit(False).alias("clears"))
    loose = made.where("scope is null").select("event_id", "scope", F.col("event_id").alias("job"), F.lit(False).alias("reused"))
    rows = made.where("scope is not null")
    if revoked is not None:
        rows = rows.unionByName(revoked.where("scope is not null").select("scope", "ts", F.lit(None).cast("long").alias("event_id"), F.lit(True).alias("clears")))

    def chain(frames):
        scope, job, until = None, None, None
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                if r.scope != scope:
                    scope, job = r.scope, None
                if r.clears:
                    job = None
                    continue
                reused = job is not None and r.at <= until
                if not reused:
                    job, until = int(r.event_id), r.at + ttl_seconds * 1_000_000
                out.append((int(r.event_id), scope, job, reused))
            yield pd.DataFrame(out, columns=["event_id", "scope", "job", "reused"])

    ordered = rows.select("scope", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "clears").repartition("scope").sortWithinPartitions("scope", "at", "clears", "event_id")
    return ordered.mapInPandas(chain, "event_id long, scope string, job long, reused boolean").unionByName(loose)


def reap_expired(jobs: DataFrame, now: str) -> DataFrame:
    """(job_id, status, scope, code): active jobs past their time become expired; a job that is expired or revoked leaves its
    scope, and the guard's code says why it can't be used."""
    over = F.to_timestamp_ntz(F.lit(now)) > F.col("created") + F.make_dt_interval(F.col("ttl_days").cast("int"))
    status = F.when((F.col("status") == "active") & over, "expired").otherwise(F.col("status"))
    code = F.when(F.col("status") == "revoked", "job_revoked").when(over, "job_expired")
    return jobs.select("job_id", status.alias("status"), F.when(status == "active", F.col("scope")).alias("scope"), code.alias("code"))


def manifest_check(manifest: DataFrame, files: DataFrame, bundle: DataFrame, data: DataFrame) -> DataFrame:
    """(area, path, problem): differences of a manifest and the files, both (path, sha), and of what a bundle says and the
    data, both (path, value) with a row a field: missing, extra or changed."""

    def differences(area: str, want: DataFrame, have: DataFrame) -> DataFrame:
        m, f = (df.select(F.col(df.columns[0]).alias("path"), F.col(df.columns[1]).alias(n), F.lit(True).alias(f"has_{n}")) for df, n in ((want, "m"), (have, "f")))
        out = m.join(f, "path", "full").where(F.col("has_m").isNull() | F.col("has_f").isNull() | ~F.col("m").eqNullSafe(F.col("f")))
        return out.select(F.lit(area).alias("area"), "path", F.when(F.col("has_f").isNull(), "missing").when(F.col("has_m").isNull(), "extra").otherwise("changed").alias("problem"))

    return differences("files", manifest, files).union(differences("data", bundle, data))


def audit_trail(events: DataFrame) -> DataFrame:
    """Actions of each job in order."""
    k = F.row_number().over(W.partitionBy("job_id").orderBy("ts", "event_id"))
    return events.select("job_id", k.cast("long").alias("step"), "action", "event_id")


def wallet_balance(ledger: DataFrame) -> DataFrame:
    """Granted, spent and balance by the entries alone: committed and open reservations count as spent."""
    total = lambda op: F.sum(F.when(F.col("op") == op, F.col("amount")).otherwise(0))
    return ledger.groupBy("principal").agg(total("topup").alias("granted"), total("reserve").alias("spent")).withColumn("balance", F.col("granted") - F.col("spent"))


@dataclass
class Wallet:
    """A principal's sums: open reservations count as spent until they are refunded."""

    balance: int = 0
    spent: int = 0
    open: int = 0
    refused: int = 0

    def step(self, op: str, amount: int, known: tuple[int, str] | None) -> tuple[int, str] | None:
        """Takes an entry; known: the (cost, state) of its reservation so far. Gives the reservation's new (cost, state) if that changes.

        A reservation needs the balance, and costs above zero. Only one that is still reserved can be committed or refunded, so
        repeated entries, and a refund after a commit, change nothing; nor does an id that is reserved again.
        """
        if op == "topup":
            self.balance += amount
        elif op == "reserve" and known is None and amount > 0:
            if self.balance >= amount:
                self.balance, self.spent, self.open = self.balance - amount, self.spent + amount, self.open + 1
                return amount, "reserved"
            self.refused += 1
        elif op in ("commit", "refund") and known is not None and known[1] == "reserved":
            self.open -= 1
            if op == "refund":
                self.balance, self.spent = self.balance + known[0], max(0, self.spent - known[0])
            return known[0], "committed" if op == "commit" else "refunded"
        return None


def ledger_fold(ledger: DataFrame) -> DataFrame:
    """(principal, balance, spent, open, refused): wallets after the entries (principal, ts, event_id, op, amount, reservation) in order.

    Whether a reservation fits depends on all before it, so a principal's entries pass one task in order; they stream through
    it, and only the principal's reservations are held.
    """

    def fold(frames):
        principal, wallet, reservations, begun = None, Wallet(), {}, False
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                if not begun or r.principal != principal:
                    if begun:
                        rows.append((principal, wallet.balance, wallet.spent, wallet.open, wallet.refused))
                    principal, wallet, reservations, begun = r.principal, Wallet(), {}, True
                after = wallet.step(r.op, int(r.amount), reservations.get(r.reservation))
                if after is not None and r.reservation == r.reservation:
                    reservations[r.reservation] = after
            yield pd.DataFrame(rows, columns=["principal", "balance", "spent", "open", "refused"])
        if begun:
            yield pd.DataFrame([(principal, wallet.balance, wallet.spent, wallet.open, wallet.refused)], columns=["principal", "balance", "spent", "open", "refused"])

    rows = ledger.where("principal is not null").select("principal", "ts", "event_id", "op", F.coalesce("amount", F.lit(0)).alias("amount"), "reservation")
    ordered = rows.repartition("principal").sortWithinPartitions("principal", "ts", "event_id")
    return ordered.mapInPandas(fold, "principal long, balance long, spent long, open long, refused long")
