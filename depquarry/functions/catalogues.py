"""Fixed values that classifications read: tiers of runtime settings, FIPS facts, capabilities of the standard library, reasons of failed scans."""

from __future__ import annotations

#: How risky a GODEBUG setting is (revision 2024-06-01). Others are unknown.
GODEBUG_TIERS = {
    "tlsrsakex": "red",
    "tls10server": "red",
    "tls3des": "red",
    "tlssha1": "red",
    "tlsmaxrsasize": "red",
    "tlsunsafeekm": "red",
    "x509ignoreCN": "red",
    "x509negativeserial": "red",
    "x509usepolicies": "red",
    "tarinsecurepath": "red",
    "zipinsecurepath": "red",
    "winsymlink": "red",
    "winreadlinkvolume": "red",
    "http2client": "amber",
    "http2server": "amber",
    "http2debug": "amber",
    "multipathtcp": "amber",
    "multipartmaxparts": "amber",
    "multipartmaxheaders": "amber",
    "randautoseed": "amber",
    "panicnil": "amber",
    "netedns0": "amber",
    "httplaxcontentlength": "amber",
    "httpmuxgo121": "amber",
    "tlskyber": "amber",
    "asynctimerchan": "green",
    "gotypesalias": "green",
    "gocachetest": "green",
    "gocachehash": "green",
    "installgoroot": "green",
    "dataindependenttiming": "green",
}

#: What the name of a toolchain build with a validated module contains (revision 2026-05-20).
FIPS_TOOLCHAINS = {
    "boringcrypto": "X:boringcrypto",
    "microsoft-fipscapable": "X:fipscapable",
    "redhat-fips": "rh-fips",
    "aws-fips": "X:awsfips",
}

#: The variant that stock toolchains are from this version on, if the fips140 setting asks for it.
FIPS_NATIVE, FIPS_NATIVE_SINCE = "go-fips140", "1.24.0"

#: Packages of algorithms outside FIPS; packages below them are not meant.
NON_FIPS_PACKAGES = (
    "crypto/md5",
    "crypto/rc4",
    "crypto/des",
    "crypto/dsa",
    "golang.org/x/crypto/md4",
    "golang.org/x/crypto/blowfish",
    "golang.org/x/crypto/ripemd160",
    "golang.org/x/crypto/cast5",
    "golang.org/x/crypto/twofish",
    "golang.org/x/crypto/tea",
    "golang.org/x/crypto/xtea",
)

#: The capability that a function of the standard library needs, where it isn't its package's.
#: The judgements are those of Capslock v0.3.2 (Copyright 2023 Google LLC, BSD-3-Clause).
FUNCTION_CAPABILITIES = {
    "os.Getenv": "READ_SYSTEM_STATE",
    "os.LookupEnv": "READ_SYSTEM_STATE",
    "os.Environ": "READ_SYSTEM_STATE",
    "os.Setenv": "MODIFY_SYSTEM_STATE",
    "os.Unsetenv": "MODIFY_SYSTEM_STATE",
    "os.Clearenv": "MODIFY_SYSTEM_STATE",
    "os.Getpid": "OPERATING_SYSTEM",
    "os.Getppid": "OPERATING_SYSTEM",
    "os.Hostname": "OPERATING_SYSTEM",
    "os.Exit": "OPERATING_SYSTEM",
    "os.Executable": "READ_SYSTEM_STATE",
    "os.Getwd": "READ_SYSTEM_STATE",
    "os.TempDir": "READ_SYSTEM_STATE",
    "os.UserHomeDir": "READ_SYSTEM_STATE",
    "os.UserConfigDir": "READ_SYSTEM_STATE",
    "os.UserCacheDir": "READ_SYSTEM_STATE",
    "os.ExpandEnv": "READ_SYSTEM_STATE",
    "os.FindProcess": "READ_SYSTEM_STATE",
    "os.Getuid": "READ_SYSTEM_STATE",
    "os.Getgid": "READ_SYSTEM_STATE",
    "os.Geteuid": "READ_SYSTEM_STATE",
    "os.Getegid": "READ_SYSTEM_STATE",
    "os.Getgroups": "READ_SYSTEM_STATE",
    "os.Getpagesize": "READ_SYSTEM_STATE",
    "os.Chdir": "MODIFY_SYSTEM_STATE",
    "os.File.Chdir": "MODIFY_SYSTEM_STATE",
    "os.StartProcess": "EXEC",
    "os/exec.LookPath": "FILES",
    "net.Interfaces": "READ_SYSTEM_STATE",
    "net.InterfaceByName": "READ_SYSTEM_STATE",
    "net.InterfaceByIndex": "READ_SYSTEM_STATE",
    "net.InterfaceAddrs": "READ_SYSTEM_STATE",
    "syscall.Getenv": "READ_SYSTEM_STATE",
    "runtime.GOROOT": "READ_SYSTEM_STATE",
    "runtime/debug.ReadBuildInfo": "READ_SYSTEM_STATE",
    "runtime/debug.WriteHeapDump": "FILES",
}

#: The capability that any other function of a package needs; from the same source.
PACKAGE_CAPABILITIES = {
    "net": "NETWORK",
    "net/http": "NETWORK",
    "net/rpc": "NETWORK",
    "net/smtp": "NETWORK",
    "net/textproto": "NETWORK",
    "os": "FILES",
    "io/ioutil": "FILES",
    "path/filepath": "FILES",
    "os/exec": "EXEC",
    "plugin": "ARBITRARY_EXECUTION",
    "reflect": "REFLECT",
    "unsafe": "UNSAFE_POINTER",
    "runtime/cgo": "CGO",
    "syscall": "SYSTEM_CALLS",
    "golang.org/x/sys/unix": "SYSTEM_CALLS",
    "golang.org/x/sys/windows": "SYSTEM_CALLS",
    "runtime": "RUNTIME",
    "runtime/debug": "RUNTIME",
    "os/user": "READ_SYSTEM_STATE",
    "os/signal": "MODIFY_SYSTEM_STATE",
    "log": "MODIFY_SYSTEM_STATE",
    "log/syslog": "MODIFY_SYSTEM_STATE",
}

#: The reason of a scan that failed, by patterns of the lower-cased message that must all be found; the first row holds.
SCAN_FAILURES = (
    ("workspace-mode", (r"in workspace mode|gowork=off to disable workspace mode",)),
    ("go-work-monorepo", (r"go\.work file", r"no such file or directory|cannot load module")),
    ("relative-replace-directive", (r"replacement directory", r"does not exist")),
    ("windows-only", (r"build constraints exclude all go files", r"windows")),
    ("c-headers-missing", (r"fatal error:", r"\.h: no such file or directory")),
    ("missing-go-sum", (r"missing go\.sum entry",)),
    ("version-not-in-toolchain", (r"module lookup disabled by goproxy=off",)),
    ("generated-assets-missing", (r"undefined: [^ \t\n(]*\.",)),
    ("package-declarations-missing", (r"undefined:",)),
    ("build-incompatible", ()),
)

#: Messages of modules that can't be loaded or built, as opposed to faults of the scanner.
BUILD_FAILURES = r"loading packages|errors with the provided package patterns|build constraints exclude all go files|no required module provides package"
