"""Behaviour rules over the symbols of binaries ``files(path, format, symbols, n_imports, packed, dotnet, high_entropy)``.

``symbols`` lists imported and dynamic names, ``n_imports`` counts the imports alone. Every rule is a column; the ones
that hold become rows, without a shuffle. A null array has no symbols.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW, MEDIUM, HIGH, CRITICAL = 30, 50, 70, 90

# Names of functions, by what they serve.
INJECTION = (
    "VirtualAlloc", "VirtualAllocEx", "VirtualProtect", "VirtualProtectEx", "WriteProcessMemory", "ReadProcessMemory", "CreateRemoteThread",
    "CreateRemoteThreadEx", "NtCreateThreadEx", "RtlCreateUserThread", "QueueUserAPC", "NtQueueApcThread", "SetThreadContext", "GetThreadContext",
    "NtMapViewOfSection", "ZwMapViewOfSection", "NtUnmapViewOfSection", "ZwUnmapViewOfSection", "OpenProcess", "NtOpenProcess", "ResumeThread",
    "SuspendThread", "WriteFileEx",
)
ANTI_DEBUG = (
    "IsDebuggerPresent", "CheckRemoteDebuggerPresent", "NtQueryInformationProcess", "NtSetInformationThread", "OutputDebugStringA",
    "OutputDebugStringW", "DebugActiveProcess", "ZwQueryInformationProcess", "ZwSetInformationThread", "FindWindowA", "FindWindowW",
    "GetTickCount", "QueryPerformanceCounter", "NtClose",
)
ANTI_VM = ("CPUID", "GetSystemFirmwareTable", "EnumSystemFirmwareTables", "GetAdaptersInfo", "GetVolumeInformationW", "GetVolumeInformationA", "GlobalMemoryStatusEx")
PERSISTENCE = (
    "RegCreateKeyExA", "RegCreateKeyExW", "RegSetValueExA", "RegSetValueExW", "RegOpenKeyExA", "RegOpenKeyExW", "CreateServiceA", "CreateServiceW",
    "OpenSCManagerA", "OpenSCManagerW", "StartServiceA", "StartServiceW", "SetWindowsHookExA", "SetWindowsHookExW", "ITaskScheduler", "CreateFileMappingW",
)
NETWORK = (
    "InternetOpenA", "InternetOpenW", "InternetOpenUrlA", "InternetOpenUrlW", "InternetConnectA", "InternetConnectW", "InternetReadFile",
    "HttpOpenRequestA", "HttpOpenRequestW", "HttpSendRequestA", "HttpSendRequestW", "WinHttpOpen", "WinHttpConnect", "WinHttpOpenRequest",
    "WinHttpSendRequest", "URLDownloadToFileA", "URLDownloadToFileW", "URLDownloadToCacheFileA", "URLDownloadToCacheFileW", "socket", "WSAStartup",
    "WSASocketA", "WSASocketW", "connect", "send", "recv", "gethostbyname", "getaddrinfo", "DnsQuery_A", "DnsQuery_W",
)
CRYPTO = (
    "CryptAcquireContextA", "CryptAcquireContextW", "CryptCreateHash", "CryptHashData", "CryptEncrypt", "CryptDecrypt", "CryptGenKey", "CryptImportKey",
    "CryptExportKey", "CryptDeriveKey", "BCryptOpenAlgorithmProvider", "BCryptEncrypt", "BCryptDecrypt", "BCryptGenerateSymmetricKey",
)
STEALER = (
    "GetClipboardData", "OpenClipboard", "EmptyClipboard", "SetClipboardData", "GetAsyncKeyState", "GetKeyState", "RegisterRawInputDevices", "BitBlt",
    "CreateCompatibleBitmap", "GetDC", "GetForegroundWindow", "GetWindowTextA", "GetWindowTextW", "EnumWindows", "CryptUnprotectData",
)
SERVICE_ACTIONS, SERVICE_MANAGER = ("CreateServiceA", "CreateServiceW", "StartServiceA", "StartServiceW"), ("OpenSCManagerA", "OpenSCManagerW")
REGISTRY_OPEN, REGISTRY_WRITE = ("RegCreateKeyExA", "RegCreateKeyExW", "RegOpenKeyExA", "RegOpenKeyExW"), ("RegSetValueExA", "RegSetValueExW")
HOOKS, KEYS = ("SetWindowsHookExA", "SetWindowsHookExW"), ("GetAsyncKeyState", "GetForegroundWindow")
SCREEN, CLIPBOARD = ("BitBlt", "CreateCompatibleBitmap", "GetDC"), ("GetClipboardData", "OpenClipboard")
LOADERS = ("LoadLibraryA", "LoadLibraryW", "LoadLibraryExA")
HTTP = ("InternetOpenA", "InternetOpenW", "WinHttpOpen", "HttpOpenRequestA", "HttpOpenRequestW")
SOCKETS, NAMES = ("socket", "WSASocketA", "WSASocketW", "WSAStartup", "connect"), ("DnsQuery_A", "DnsQuery_W", "gethostbyname", "getaddrinfo")
SHELL, EXEC, POSIX_LOADER = ("socket", "connect", "dup2"), ("execve", "execvp", "execv"), ("dlopen", "dlsym", "mprotect")
THIN_IMPORTS = 6


def _names(values) -> Column:
    return F.array(*[F.lit(x) for x in values])


def _hits(*tables) -> Column:
    return F.sort_array(F.array_intersect(F.coalesce("symbols", F.array().cast("array<string>")), _names(dict.fromkeys(x for t in tables for x in t))))


def _count(table) -> Column:
    return F.size(_hits(table))


def _any(table) -> Column:
    return _count(table) > 0


def _all(table) -> Column:
    return _count(table) == len(table)


def rules() -> list[tuple[str, int | Column, str, Column, Column]]:
    """(rule, severity, category, condition, evidence), in the order of their report."""
    none = F.array().cast("array<string>")
    posix = F.col("format").isin("elf", "macho")
    packed = F.coalesce("packed", F.lit(False))
    injection = _count(INJECTION)
    service = _any(SERVICE_ACTIONS) & _any(SERVICE_MANAGER)
    registry = _any(REGISTRY_OPEN) & _any(REGISTRY_WRITE)
    encrypted = _any(HTTP) & _any(CRYPTO)
    resolves = _all(("GetProcAddress",)) & _any(LOADERS)
    return [
        ("combo.process_injection", CRITICAL, "injection", injection >= 3, _hits(INJECTION)),
        ("combo.process_injection_partial", MEDIUM, "injection", injection == 2, _hits(INJECTION)),
        ("combo.anti_debug", MEDIUM, "anti_debug", _count(ANTI_DEBUG) >= 3, _hits(ANTI_DEBUG)),
        ("combo.anti_vm", MEDIUM, "anti_vm", _count(ANTI_VM) >= 2, _hits(ANTI_VM)),
        ("combo.service_install", HIGH, "persistence", service, _hits(SERVICE_ACTIONS[:2], SERVICE_MANAGER)),
        ("combo.registry_persistence", MEDIUM, "persistence", registry & ~service, _hits(PERSISTENCE)),
        ("combo.keylogger", HIGH, "infostealer", _all(KEYS) | _any(HOOKS), _hits(KEYS, HOOKS, ("GetWindowTextA", "GetWindowTextW"))),
        ("combo.screenshot_capture", HIGH, "infostealer", _count(SCREEN) >= 2, _hits(SCREEN)),
        ("combo.clipboard_stealer", MEDIUM, "infostealer", _all(CLIPBOARD), _hits(CLIPBOARD)),
        ("combo.dpapi_dump", HIGH, "infostealer", _all(("CryptUnprotectData",)), _hits(("CryptUnprotectData",))),
        ("combo.dynamic_resolution", F.when(packed | F.coalesce("high_entropy", F.lit(False)), MEDIUM).otherwise(LOW), "injection", resolves, _names(("GetProcAddress", "LoadLibrary*"))),
        ("combo.crypto_c2", MEDIUM, "c2", encrypted, _hits(NETWORK, CRYPTO)),
        ("combo.raw_socket_c2", LOW, "c2", _any(SOCKETS) & _any(NAMES) & ~encrypted, _hits(NETWORK)),
        ("combo.infostealer_battery", HIGH, "infostealer", _count(STEALER) >= 4, _hits(STEALER)),
        ("pe.no_imports", HIGH, "injection", (F.col("format") == "pe") & ~F.coalesce("dotnet", F.lit(False)) & (F.col("n_imports") == 0), none),
        ("combo.packed_thin_imports", MEDIUM, "packer", packed & F.col("n_imports").between(1, THIN_IMPORTS), none),
        ("combo.posix_reverse_shell", HIGH, "c2", posix & _all(SHELL) & _any(EXEC), _names(("socket", "connect", "dup2", "execve"))),
        ("combo.posix_in_memory_loader", MEDIUM, "injection", posix & _all(POSIX_LOADER), _names(POSIX_LOADER)),
    ]


def findings(files: DataFrame) -> DataFrame:
    """(path, rule, severity, category, evidence) for every rule that a file meets."""
    met = [F.when(c, F.struct(F.lit(r).alias("rule"), (s if isinstance(s, Column) else F.lit(s)).alias("severity"), F.lit(k).alias("category"), e.alias("evidence"))) for r, s, k, c, e in rules()]
    return files.select("path", F.explode(F.array_compact(F.array(*met))).alias("f")).select("path", "f.*")
