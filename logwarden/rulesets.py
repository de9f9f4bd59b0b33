"""Built-in rule sets, as data.

Each entry is (kind, pattern, score, report flag, report categories). ``%i`` marks the
address and ``%p`` the port. Own rules come from `logwarden.sources.config_file`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logwarden import schemas

# Rule patterns, scores and report categories, in matching order.
OPENSSH = [
    ("activity", r"""^.+? sshd\[\d+\]: Invalid user .+? from %i""", 2, None, None),
    ("activity", r"""^.+? sshd\[\d+\]: Invalid user .+? from %i port %p""", 2, None, None),
    ("activity", r"""^.+? sshd\[\d+\]: error: PAM: Authentication failure for .+? from %i""", 1, None, None),
    ("activity", r"""^.+? sshd\[\d+\]: ROOT LOGIN REFUSED FROM %i""", 20, None, None),
    ("activity", r"""^.+? sshd\[\d+\]: SSH: Server;Ltype: Authname;Remote: %i-\d+;Name: root \[preauth\]""", 20, None, None),
    ("activity", r"""^.+? sshd\[\d+\]: Did not receive identification string from %i""", 1, None, [14]),
    ("activity", r"""^.+? sshd\[\d+\]: Did not receive identification string from %i port %p""", 1, None, [14]),
    ("activity", r"""^.+? sshd\[\d+\]: User .+? from %i not allowed because not listed in AllowUsers""", 2, None, None),
    ("activity", r"""^.+? sshd\[\d+\]: pam_unix\(sshd:auth\): authentication failure; logname= uid=0 euid=0 tty=ssh ruser= rhost=%i""", 1, None, None),
    ("activity", r"""^.+? sshd\[\d+\]: Postponed keyboard-interactive for invalid user .+? from %i port %p ssh2 \[preauth\]""", 2, None, None),
    ("activity", r"""^.+? sshd\[\d+\]: PAM: Authentication failure for illegal user .+? from %i""", 2, None, None),
    ("activity", r"""^.+? sshd\[\d+\]: Failed keyboard-interactive/pam for invalid user .+? from %i port %p ssh2""", 2, None, None),
    ("activity", r"""^.+? sshd\[\d+\]: Disconnecting: Too many authentication failures for invalid user .+? from %i port %p ssh2 \[preauth\]""", 2, None, None),
    ("activity", r"""^.+? sshd\[\d+\]: Disconnecting invalid user .+? %i port %p: Too many authentication failures \[preauth\]""", 2, None, None),
    ("activity", r"""^.+? sshd\[\d+\]: Failed password for invalid user .+? from %i port %p ssh2""", 2, None, None),
    ("activity", r"""^.+? sshd\[\d+\]: error: maximum authentication attempts exceeded for invalid user .+? from %i port %p ssh2 \[preauth\]""", 2, None, None),
    ("activity", r"""^.+? sshd\[\d+\]: Connection closed by %i port %p \[preauth\]""", 0, False, None),
    ("activity", r"""^.+? sshd\[\d+\]: Disconnected from %i port %p \[preauth\]""", 0, False, None),
    ("refused", r"""^.+? kernel: \[\s?\d+\.\d+\] IPTABLES-DROPPED: .+? SRC=%i .+? DPT=22 .+?""", 5, None, None),
    ("refused", r"""^.+? kernel: \[\s?\d+\.\d+\] IPTABLES-DROPPED: .+? SRC=%i .+? DPT=25 .+?""", 5, None, None),
    ("refused", r"""^.+? kernel: \[\s?\d+\.\d+\] IPTABLES-DROPPED: .+? SRC=%i .+? DPT=80 .+?""", 5, None, None),
    ("refused", r"""^.+? kernel: \[\s?\d+\.\d+\] IPTABLES-DROPPED: .+? SRC=%i .+? DPT=110 .+?""", 5, None, None),
    ("refused", r"""^.+? kernel: \[\s?\d+\.\d+\] IPTABLES-DROPPED: .+? SRC=%i .+? DPT=143 .+?""", 5, None, None),
    ("refused", r"""^.+? kernel: \[\s?\d+\.\d+\] IPTABLES-DROPPED: .+? SRC=%i .+? DPT=443 .+?""", 5, None, None),
    ("refused", r"""^.+? kernel: \[\s?\d+\.\d+\] IPTABLES-DROPPED: .+? SRC=%i .+? DPT=465 .+?""", 5, None, None),
    ("refused", r"""^.+? kernel: \[\s?\d+\.\d+\] IPTABLES-DROPPED: .+? SRC=%i .+? DPT=587 .+?""", 5, None, None),
    ("refused", r"""^.+? kernel: \[\s?\d+\.\d+\] IPTABLES-DROPPED: .+? SRC=%i .+? DPT=993 .+?""", 5, None, None),
    ("refused", r"""^.+? kernel: \[\s?\d+\.\d+\] IPTABLES-DROPPED: .+? SRC=%i .+? DPT=995 .+?""", 5, None, None),
    ("refused", r"""^.+? kernel: \[\s?\d+\.\d+\] IPTABLES-DROPPED: .+? SRC=%i .+? DPT=%p .+?""", 5, None, None),
]

APACHE_ACCESS = [
    ("activity", r"""^%i .+?\/user\/soapCaller\.bs.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/muieblackcat.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?(?:phpmy|php\-my|my|mysql|web|php|db|database|phppg|sqlite)(?:admin|\-admin|manager|\-manager|dumper|-\dumper).+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/wp\-admin.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/_vti_bin\/_vti_aut\/author\.dll.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/freepbx\/config\.php.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/manager\/html.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?GET \/axis2.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/jmx\-console.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/(?:bea_wls_deployment_internal|bea_wls_cluster_internal|bea_wls_internal|inspection.wsil|uddiexplorer).+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/drupal.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/joomla\/administrator.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/jenkins\/script.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/connectors\/system\/phpthumb\.php.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/plugins\/weathermap\/editor\.php.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/flex2gateway\/(?:amf|amfpolling|http|httpsecure|cfamfpolling).+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?GET \/webdav.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/(?:xx|w|xw|s)\.php.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/cmd\.jsp.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/FxCodeShell\.jsp.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/\.git\/.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/etc\/passwd.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/GponForm\/diag_Form\?images.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/wls\-wsat\/CoordinatorPortType HTTP.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?compatible; Nmap Scripting Engine;.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/Diagnostics\.asp.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/CFIDE\/(?:product\.cfm|administrator\/).+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/wp-content\/plugins\/ezpz\-one\-click\-backup\/functions\/ezpz\-archive\-cmd\.php.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/invoker\/readonly.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\?debug\=browser&object\=\(%23_memberAccess\=@ognl.OgnlContext@DEFAULT_MEMBER_ACCESS\).+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/index\.php\?s\=\/index\/\\\\think\\\\app\/invokefunction\&function\=call_user_func_array.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/(?:apps\/|jax_|CGI)?(?:Guestbook|guestbook|gastenboek|gaestebuch|g_book|gb)(?:\.(?:php|html|cgi))?.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?http:\/\/check\.proxyradar\.com\/azenv\.php\?auth.+?""", 2, True, [9]),
    ("activity", r"""^%i .+?HEAD.+?\/check_proxy.+?""", 2, True, [9]),
    ("activity", r"""^%i .+?CONNECT.+?antei\.xyz.+?""", 2, True, [9]),
    ("activity", r"""^%i .+?\/onvif\-http\/snapshot\?auth\=YWRtaW46MTEK.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/currentsetting\.htm.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/webfig\/roteros\.info.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?GET \/winbox\.png.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/(?:hndUnblock|tmUnblock)\.cgi.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/HNAP1\/.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?servlet\?p\=login\&q\=loginForm\&jumpto\=status.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/cgi\-bin\/luci\/;stok\=redacted\/expert\/maintenance\/diagnostic\/nslookup.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/stssys\.htm.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/stalker_portal\/server\/adm.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/000000000000\.cfg.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/aastra\.cfg.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/current_config\/passwd.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/cgi\-bin\/kerbynet\?.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/command\.php.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/common\.cgi.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/login\.cgi\?.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/search\.cgi\?.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/wuwu11\.php.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\/shell\?.+?""", 2, True, [15, 21]),
    ("activity", r"""^%i .+?\?XDEBUG_SESSION_START\=phpstorm.+?""", 2, True, [15, 21]),
]

MAIL = [
    ("activity", r"""^.+? dovecot: pop3-login: Aborted login \(tried to use disallowed plaintext auth\): .+? rip=%i,.+?""", 1, True, [11, 18]),
    ("activity", r"""^.+? postfix\/smtps\/smtpd\[\s?\d+\]: SSL_accept error from .+?\[%i\]: -1$""", 1, True, [11, 18]),
    ("activity", r"""^.+? postfix\/smtps\/smtpd\[\s?\d+\]: improper command pipelining after QUIT from .+?\[%i\].+?""", 1, True, [11, 18]),
    ("activity", r"""^.+? postfix\/smtps\/smtpd\[\s?\d+\]: NOQUEUE: reject: RCPT from unknown\[%i\]: .+? Relay access denied; from=.+? to=.+? proto=.+? helo=.+?""", 1, True, [11, 18]),
]

NAMED = [
    ("activity", r"""^.+? named\[\s?\d+\]: client %i.+?: query \(cache\) .+? denied""", 1, True, [14, 15]),
]

GROUPS = {
    "OpenSSH": OPENSSH,
    "ApacheAccess": APACHE_ACCESS,
    "Mail": MAIL,
    "Named": NAMED,
}

DEFAULT_GROUPS = ("OpenSSH",)


def builtin_rules(spark: SparkSession, groups=DEFAULT_GROUPS) -> DataFrame:
    """The built-in rules of the given log groups as a rules table."""
    rows = []
    for group_idx, name in enumerate(groups):
        position = {"activity": 0, "refused": 0}
        for kind, pattern, score, report, categories in GROUPS[name]:
            rows.append((name, group_idx, kind, position[kind], pattern, score, report, categories or [], None))
            position[kind] += 1
    return spark.createDataFrame(rows, schemas.RULES)
