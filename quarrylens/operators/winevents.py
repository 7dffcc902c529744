"""Detections over Windows events ``events(file, record_id, event_id, channel, provider, fields map<string,string>)``.

A rule is a condition, how often it must hold for a key, and what its evidence shows. Simple rules are expanded from
one scan of the events and counted together; the rules that compare users or sources have functions of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Severities, weak encryption types, lists of names, and patterns of suspicious command lines.
LOW, MEDIUM, HIGH, CRITICAL = 30, 50, 70, 90
WEAK_ETYPES = (0x17, 0x18, 0x3)
LOLBINS = (
    "certutil.exe", "mshta.exe", "wscript.exe", "cscript.exe", "regsvr32.exe", "regsvcs.exe", "regasm.exe", "installutil.exe", "msiexec.exe",
    "wmic.exe", "powershell.exe", "pwsh.exe", "rundll32.exe", "schtasks.exe", "at.exe", "bitsadmin.exe", "msdt.exe", "odbcconf.exe", "cmstp.exe",
    "msbuild.exe", "dnscmd.exe", "pcalua.exe", "xwizard.exe", "appsyncpublishingserver.exe", "presentationhost.exe", "syncappvpublishingserver.exe",
    "infdefaultinstall.exe", "ieexec.exe", "msdeploy.exe", "bginfo.exe", "csi.exe", "dnsclient.exe", "ftp.exe", "bash.exe", "wsl.exe",
    "diskshadow.exe", "esentutl.exe", "expand.exe", "extrac32.exe", "findstr.exe", "forfiles.exe", "hh.exe", "makecab.exe", "mavinject.exe",
    "microsoft.workflow.compiler.exe", "mmc.exe", "mtstocom.exe", "nltest.exe", "ntdsutil.exe", "cfc.exe", "reg.exe", "regsvc.exe", "replace.exe",
    "rpcping.exe", "runscripthelper.exe", "sc.exe", "scriptrunner.exe", "wab.exe", "wfc.exe", "winrm.cmd", "aspnet_compiler.exe", "adplus.exe",
)
SENSITIVE_GROUPS = (
    "Domain Admins",
    "Enterprise Admins",
    "Schema Admins",
    "Administrators",
    "Account Operators",
    "Backup Operators",
    "Print Operators",
    "Server Operators",
    "Group Policy Creator Owners",
    "Remote Desktop Users",
    "Network Configuration Operators",
    "BUILTIN\\Administrators",
)
ENCODED = r"(?i)-(?:enc|encodedcommand)\s+[A-Za-z0-9+/=]{20,}"
SUSPICIOUS = (
    r"(?i)(-enc(?:odedCommand)?\s+[A-Za-z0-9+/=]{20,}|IEX\s*\(|Invoke-Expression|\bDownloadString\b|\bDownloadFile\b|\bInvoke-WebRequest\b|\biex\b|\.Invoke\(|FromBase64String"
    r"|\bAdd-Type\b.*-TypeDefinition|\[Runtime\.InteropServices|\bVirtualAlloc\b|CreateThread|\bbypass\b.*-executionpolicy|-ExecutionPolicy\s+Bypass|\bNetWebClient\b"
    r"|System\.Net\.WebClient|\bCompress-Archive\b.*-Force|\bSet-MpPreference\b.*-Disable|AMSI)"
)
SPRAY_USERS, BRUTE_FORCE = 5, 10


def field(name: str) -> Column:
    return F.coalesce(F.col("fields")[name], F.lit(""))


def basename(path: Column) -> Column:
    return F.lower(F.element_at(F.split(F.translate(F.regexp_replace(path, '^"|"$', ""), "\\", "/"), "/"), -1))


def has_address(value: Column) -> Column:
    odd = value.isin("-", "LOCAL", "", "::1", "127.0.0.1")
    return ~odd & value.rlike(r"^\d{1,3}(\.\d{1,3}){3}$|^[0-9A-Fa-f:]{2,}$")


def _number(value: Column) -> Column:
    """Decimal or hexadecimal (0x) numbers, with any number of leading zeros."""
    return F.when(value.rlike("^0[xX][0-9A-Fa-f]+$"), F.conv(F.substring(value, 3, 16), 16, 10).try_cast("long")).otherwise(value.try_cast("long"))


def rules() -> list[tuple[str, int, Column, Column, int]]:
    """(rule, severity, condition, evidence, least count in a file)."""
    e = F.col("event_id")
    image, command = basename(field("NewProcessName")), field("CommandLine")
    encoded, odd = (e == 4688) & command.rlike(ENCODED), command.rlike(SUSPICIOUS)
    weak = _number(field("TicketEncryptionType")).isin(*WEAK_ETYPES)
    service = field("ServiceName")
    group = field("TargetUserName")
    in_group = e.isin(4728, 4732, 4756)
    sensitive = group.isin(*SENSITIVE_GROUPS) | group.contains("Admin") | group.contains("admin")
    user, source = group, field("IpAddress")
    port = field("DestinationPort").try_cast("int")
    return [
        ("security_log_cleared", CRITICAL, e == 1102, field("SubjectUserName"), 1),
        ("system_log_cleared", CRITICAL, (e == 104) & (F.col("channel").contains("System") | F.col("provider").endswith("Eventlog")), F.col("channel"), 1),
        ("kerberoasting", HIGH, (e == 4769) & weak & (service != "") & ~service.endswith("$"), service, 1),
        ("asrep_roasting", HIGH, (e == 4768) & weak, user, 1),
        ("rdp_logon", MEDIUM, (e == 4624) & (field("LogonType") == "10"), source, 1),
        ("network_logon", LOW, (e == 4624) & (field("LogonType") == "3") & has_address(source), source, 1),
        ("explicit_credential_logon", MEDIUM, e == 4648, user, 1),
        ("lolbin_execution", MEDIUM, (e == 4688) & image.isin(*LOLBINS), image, 1),
        ("encoded_powershell", HIGH, encoded, command, 1),
        ("suspicious_cmdline", MEDIUM, (e == 4688) & odd & ~command.rlike(ENCODED), command, 1),
        ("suspicious_ps_script_block", HIGH, (e == 4104) & field("ScriptBlockText").rlike(SUSPICIOUS), field("ScriptBlockText"), 1),
        ("scheduled_task_created", HIGH, e == 4698, field("TaskName"), 1),
        ("new_service", HIGH, e.isin(7045, 4697), service, 1),
        ("account_created", HIGH, e == 4720, user, 1),
        ("sensitive_group_change", HIGH, in_group & sensitive, group, 1),
        ("group_membership_change", LOW, in_group & ~sensitive, group, 1),
        ("admin_share_access", MEDIUM, (e == 5140) & field("ShareName").rlike(r"ADMIN\$|C\$|D\$|IPC\$"), field("ShareName"), 1),
        ("privileged_logon", MEDIUM, (e == 4672) & ~field("SubjectUserName").contains("SYSTEM") & ~field("SubjectUserName").contains("$"), field("SubjectUserName"), 1),
        ("lsass_access", CRITICAL, (e == 10) & basename(field("TargetImage")).isin("lsass.exe", "lsaiso.exe"), field("SourceImage"), 1),
        ("pipe_lsass_connect", CRITICAL, (e == 18) & F.lower(field("PipeName")).startswith("\\lsass"), field("Image"), 1),
        ("pipe_create_suspicious", HIGH, (e == 17) & F.lower(field("Image")).rlike(r"\\(temp|public|programdata)\\"), field("PipeName"), 1),
        ("defender_threat_detected", HIGH, e == 1116, field("Threat Name"), 1),
        ("defender_threat_actioned", HIGH, e == 1117, field("Threat Name"), 1),
        ("sysmon_rare_port", LOW, (e == 3) & port.between(1024, 65535) & ~port.isin(1433, 1521, 3128, 3306, 3389, 5432, 5985, 5986, 8000, 8080, 8443, 8888), port.cast("string"), 3),
        ("firewall_disabled", HIGH, e.isin(4950, 2004) & field("SettingValue").rlike("Disabled|Off"), field("SettingValue"), 1),
        ("account_lockout", LOW, e == 4740, user, 3),
        ("password_reset", MEDIUM, e.isin(4723, 4724), user, 1),
        ("wmi_execution", MEDIUM, (e == 4688) & (basename(field("ParentProcessName")).isin("wmiprvse.exe", "wmic.exe") | (image == "wmic.exe")), image, 1),
        ("registry_persistence", HIGH, e.isin(4657, 12, 13) & (field("ObjectName").rlike(r"\\Run(Once)?\\") | field("TargetObject").rlike(r"\\Run(Once)?\\")), F.concat(field("ObjectName"), field("TargetObject")), 1),
        ("ntlm_auth", LOW, e == 4776, user, 5),
        ("create_remote_thread", CRITICAL, (e == 8) & ~basename(field("SourceImage")).isin("werfault.exe", "wermgr.exe"), field("SourceImage"), 1),
    ]


#: Rules that give a finding an event; all others give one a file.
EACH_EVENT = ("evtx.security_log_cleared", "evtx.system_log_cleared")


def rule_findings(events: DataFrame, evidence: int = 20, width: int | None = None) -> DataFrame:
    """(file, rule, severity, n, evidence): one row a rule and file, for cleared logs one row an event.

    A change of some group is reported only for files without a change of a sensitive one. Detected threats are
    critical if one of them is severe. Evidence lists the ``evidence`` first distinct values in order (of at most
    ``width`` characters, if given): they are ranked before they are gathered, so a rule that very many events meet
    sends few of them.
    """
    severe = F.when((F.col("event_id") == 1116) & field("Severity Name").rlike("Severe|High"), CRITICAL)
    shown = lambda x: F.substring(x, 1, width) if width else x
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(f"evtx.{r}").alias("rule"), F.lit(s).alias("s"), shown(x).alias("x"), F.lit(least).alias("least"))) for r, s, c, x, least in rules()]))
    each = events.select("file", "record_id", severe.alias("severe"), F.explode(hits).alias("h"))
    severity = F.when(F.col("h.rule") == "evtx.defender_threat_detected", F.coalesce("severe", "h.s")).otherwise(F.col("h.s"))
    alone = F.when(F.col("h.rule").isin(*EACH_EVENT), F.col("record_id"))
    keys = ["file", "rule", "record"]
    each = each.select("file", F.col("h.rule").alias("rule"), alone.alias("record"), severity.alias("severity"), "h.least", "h.x")
    each = each.groupBy(*keys, "least", "x").agg(F.count("*").alias("n"), F.max("severity").alias("severity"))
    counts = each.groupBy(*keys, "least").agg(F.sum("n").alias("n"), F.max("severity").alias("severity")).where("n >= least")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("x"))
    some = each.where("x <> ''").select(*keys, "x", place.alias("place")).where(F.col("place") <= evidence)
    some = some.groupBy(*keys).agg(F.sort_array(F.collect_list("x")).alias("evidence"))
    same = [counts[k].eqNullSafe(some[k]) for k in keys]
    found = counts.join(some, same, "left").select(*[counts[k] for k in ("file", "rule", "severity", "n")], F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))
    sensitive = counts.where("rule = 'evtx.sensitive_group_change'").select("file", F.lit("evtx.group_membership_change").alias("rule"))
    return found.join(sensitive, ["file", "rule"], "left_anti").select("file", "rule", "severity", "n", "evidence")


def brute_force(events: DataFrame, count: int = BRUTE_FORCE) -> DataFrame:
    failed = events.where("event_id = 4625").groupBy("file", field("TargetUserName").alias("user")).agg(F.count("*").alias("n"))
    return failed.where(F.col("n") >= count)


def password_spray(events: DataFrame, users: int = SPRAY_USERS) -> DataFrame:
    failed = events.where("event_id = 4625").groupBy("file", field("IpAddress").alias("source")).agg(F.count_distinct(field("TargetUserName")).alias("n_users"))
    return failed.where(F.col("n_users") >= users)


def success_after_failures(events: DataFrame) -> DataFrame:
    """Users that logged on and also failed to; the order of the two does not matter."""
    user = field("TargetUserName").alias("user")
    good = events.where("event_id = 4624").groupBy("file", user).agg(F.count("*").alias("n_logons"))
    bad = events.where("event_id = 4625").select("file", user).distinct()
    return good.join(bad, ["file", "user"], "left_semi")


def most_common(events: DataFrame, value: str, order: str, k: int = 1) -> DataFrame:
    """The k most frequent values; of equals the one seen first."""
    return events.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(k)
