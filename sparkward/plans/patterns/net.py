"""Addresses: the patterns that are looked for, in order. Fixed values, as JavaScript regular expressions."""

#: (id, severity, sub-category, title, description, expression, flags)
PATTERNS = (
    ("net.paste_services", "high", "", "数据发送到粘贴服务", "向粘贴/剪贴板服务发送数据——常用于数据外泄。",
     r"\b(pastebin\.com|paste\.ee|hastebin\.com|dpaste\.org|ghostbin\.\w+|privatebin\.net|rentry\.co)\b", "i"),
    ("net.paste_services_b", "high", "", "数据发送到粘贴服务", "向粘贴/剪贴板服务发送数据——常用于数据外泄。",
     r"\b(paste\.mozilla\.org|toptal\.com\/developers\/hastebin|cl1p\.net|controlc\.com)\b", "i"),
    ("net.file_sharing", "high", "", "数据发送到文件共享服务", "向匿名文件共享服务上传数据。",
     r"\b(transfer\.sh|file\.io|0x0\.st|tmpfiles\.org|gofile\.io|temp\.sh|oshi\.at|catbox\.moe|fileditch\.com|anonfiles\.com|sendspace\.com|dropmefiles\.com)\b", "i"),
    ("net.webhook_tunnel", "high", "", "数据发送到请求捕获/隧道服务", "向 webhook/请求捕获/隧道服务发送数据——潜在外泄端点。",
     r"\b(webhook\.site|requestbin\.com|hookbin\.com|pipedream\.net|ngrok\.\w+|ngrok-free\.app|bore\.pub|localtunnel\.me|serveo\.net|localhost\.run|trycloudflare\.com|beeceptor\.com|pinggy\.io)\b", "i"),
    ("net.tunnel_services", "high", "", "数据发送到隧道服务", "向隧道/端口转发服务发送数据——潜在外泄端点。",
     r"\b(playit\.gg|telebit\.cloud|remote\.it|portmap\.io)\b", "i"),
    ("net.tor_onion", "critical", "", "Tor 隐藏服务访问", "尝试访问 Tor .onion 地址。",
     r"\.onion\b", "i"),
    ("net.raw_ipv4", "medium", "", "直接 IP 地址连接", "连接到裸 IP 地址而非域名——可能是 C2 通信。",
     r"(?:https?|ftp|wss?|gopher|ldap|dict|sftp|telnet|tftp):\/\/\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d+)?", "i"),
    ("net.raw_ipv6", "medium", "", "IPv6 直接地址连接", "连接到裸 IPv6 地址而非域名——可能是 C2 通信。",
     r"(?:https?|ftp|wss?|gopher|ldap|dict|sftp|telnet|tftp):\/\/\[[0-9a-fA-F:]+\]", "i"),
    ("net.decimal_ip", "high", "", "十进制编码 IP 连接", "通过十进制编码 IP 地址连接——绕过域名检测的常见 C2 手法。",
     r"(?:https?|ftp|wss?|gopher|ldap|dict|sftp|telnet|tftp):\/\/\d{8,10}(?:[:/]|$)", "i"),
    ("net.octal_ip", "high", "", "八进制编码 IP 连接", "通过八进制编码 IP 地址连接——绕过域名检测的 C2 手法。",
     r"(?:https?|ftp|wss?|gopher|ldap|dict|sftp|telnet|tftp):\/\/0[0-7]{2,3}(?:\.0?[0-7]{1,3}){3}", "i"),
    ("net.hex_ip", "high", "", "十六进制编码 IP 连接", "通过十六进制编码 IP 地址连接——绕过域名检测的 C2 手法。",
     r"(?:https?|ftp|wss?|gopher|ldap|dict|sftp|telnet|tftp):\/\/0x[0-9a-fA-F]+(?:\.0x[0-9a-fA-F]+){0,3}(?:[:/]|$)", "i"),
    ("net.mining_pool", "high", "", "加密货币挖矿端点", "连接到疑似加密货币挖矿池。",
     r"\b(mining-?pool|crypto-?pool|stratum\+tcp|xmrig|hashrate\.\w+|minergate)", "i"),
    ("net.dns_oob", "high", "", "DNS 外泄/交互服务", "连接到 DNS 外泄或带外交互测试服务。",
     r"\b(dnsbin\.zhack\.ca|ceye\.io|oob\.li|interact\.sh|oast\.\w+|burpcollaborator\.net|canarytokens\.com|requestrepo\.com)\b", "i"),
    ("net.aws_metadata", "critical", "", "云实例元数据访问", "访问云实例元数据服务 (169.254.169.254)——常见 SSRF 凭证窃取目标。",
     r"169\.254\.169\.254", ""),
    ("net.gcp_metadata", "critical", "", "GCP 元数据服务访问", "访问 GCP 实例元数据服务——可获取服务账号凭证。",
     r"metadata\.google\.internal", "i"),
    ("net.azure_metadata", "critical", "", "Azure 元数据服务访问", "访问 Azure 实例元数据服务——可获取托管身份凭证。",
     r"metadata\.azure\.com", "i"),
    ("net.oracle_metadata", "critical", "", "Oracle Cloud 元数据访问", "访问 Oracle Cloud 实例元数据服务。",
     r"metadata\.oraclecloud\.com", "i"),
    ("net.digitalocean_metadata", "critical", "", "DigitalOcean 元数据访问", "访问 DigitalOcean Droplet 元数据服务。",
     r"\bmetadata\.internal\b", "i"),
    ("net.k8s_api", "medium", "", "Kubernetes API 内部访问", "从 Pod 内部访问 Kubernetes API——可能获取集群权限。",
     r"\bkubernetes\.default\.svc\b", "i"),
    ("net.metadata_decimal", "critical", "", "云元数据访问（十进制 IP）", "十进制编码访问云元数据端点 (169.254.169.254)。",
     r"\b2852039166\b", ""),
    ("net.metadata_hex", "critical", "", "云元数据访问（十六进制 IP）", "十六进制编码访问云元数据端点 (169.254.169.254)。",
     r"0xa9[.]?fe[.]?a9[.]?fe|0xa9fea9fe", "i"),
    ("net.metadata_octal", "critical", "", "云元数据访问（八进制 IP）", "八进制编码访问云元数据端点 (169.254.169.254)。",
     r"0251[.]0376[.]0251[.]0376", ""),
    ("net.metadata_v6mapped_dotted", "critical", "", "云元数据访问（IPv6 映射 - dotted）", "IPv6 映射地址访问云元数据端点 (169.254.169.254)。",
     r"\[::ffff:169\.254\.169\.254\]", "i"),
    ("net.metadata_v6_full_hex", "critical", "", "云元数据访问（IPv6 映射 - hex）", "IPv6 全零展开形式访问云元数据端点。",
     r"\[(?:0:){5}ffff:a9fe:a9fe\]", "i"),
    ("net.metadata_v6_short_hex", "critical", "", "云元数据访问（IPv6 映射 - 压缩 hex）", "IPv6 压缩形式 hex 地址访问云元数据端点。",
     r"\[::ffff:a9fe:a9fe\]", "i"),
    ("net.metadata_v4compat", "critical", "", "云元数据访问（IPv4 兼容 IPv6）", "IPv4 兼容 IPv6 地址访问云元数据端点——绕过 IPv6 映射检测。",
     r"\[::169\.254\.169\.254\]", "i"),
    ("net.metadata_v6_expanded_dotted", "critical", "", "云元数据访问（IPv6 展开 dotted）", "IPv6 完全展开形式（dotted-decimal）访问云元数据端点。",
     r"\[0{1,4}:0{1,4}:0{1,4}:0{1,4}:0{1,4}:ffff:169\.254\.169\.254\]", "i"),
    ("net.mixed_encoding_ip", "high", "", "混合编码 IP 连接", "通过混合十六进制/十进制编码 IP 地址连接——绕过域名检测的 C2 手法。",
     r"(?:https?|ftp|wss?):\/\/(?:(?:0x[0-9a-fA-F]+\.(?:0x[0-9a-fA-F]+|\d{1,3})\.(?:0x[0-9a-fA-F]+|\d{1,3})\.(?:0x[0-9a-fA-F]+|\d{1,3}))|(?:(?:0x[0-9a-fA-F]+|\d{1,3})\.(?:0x[0-9a-fA-F]+|\d{1,3})\.(?:0x[0-9a-fA-F]+|\d{1,3})\.0x[0-9a-fA-F]+))", "i"),
    ("net.tencent_metadata", "critical", "", "腾讯云元数据访问", "访问腾讯云 CVM 元数据服务 (metadata.tencentyun.com)。",
     r"\bmetadata\.tencentyun\.com\b", "i"),
    ("net.wildcard_dns_metadata", "critical", "", "DNS 通配符元数据绕过", "通过 DNS 通配符服务 (nip.io/sslip.io) 访问云元数据——绕过域名检测。",
     r"169\.254\.169\.254\.(?:nip|sslip|xip)\.io", "i"),
    ("net.alibaba_metadata", "critical", "", "阿里云元数据访问", "访问阿里云 ECS 元数据服务 (100.100.100.200)。",
     r"100\.100\.100\.200", ""),
    ("net.ecs_metadata", "critical", "", "AWS ECS 任务元数据访问", "访问 AWS ECS 任务元数据端点 (169.254.170.2)——可获取任务角色凭证。",
     r"169\.254\.170\.2", ""),
    ("net.file_scheme", "high", "", "file:// 协议访问", "使用 file:// 协议访问本地文件——可能是 SSRF 本地文件读取。",
     r"\bfile:\/\/", "i"),
    ("net.dns_rebinding", "medium", "", "DNS 重绑定域名访问", "使用已知 DNS 重绑定域名（解析为 127.0.0.1）——可能是 SSRF 绕过。",
     r"\b(localtest\.me|lvh\.me|vcap\.me|lacolhost\.com)\b", "i"),
    ("net.loopback", "medium", "", "本地回环地址访问", "连接到 localhost/127.x.x.x/0.0.0.0——可能是 SSRF 攻击。",
     r"(?:https?|ftp|wss?|gopher|ldap|dict|sftp|telnet|tftp):\/\/(?:localhost|127\.\d{1,3}\.\d{1,3}\.\d{1,3}|0\.0\.0\.0)(?:[:/]|$)", "i"),
    ("net.short_loopback", "medium", "", "短格式回环地址访问", "通过短格式回环 IP（127.1 等）连接——SSRF 绕过手法。",
     r"(?:https?|ftp|wss?|gopher|ldap|dict|sftp|telnet|tftp):\/\/127\.\d{1,3}(?:\.\d{1,3})?(?:[:/]|$)", "i"),
    ("net.zero_address", "medium", "", "零地址访问", "连接到 0 地址（解析为 0.0.0.0）——SSRF 绕过手法。",
     r"(?:https?|ftp|wss?|gopher|ldap|dict|sftp|telnet|tftp):\/\/0(?:[:/]|$)", ""),
    ("net.v6_loopback", "medium", "", "IPv6 本地回环地址访问", "连接到 IPv6 localhost (::1)——可能是 SSRF 攻击。",
     r"(?:https?|ftp|wss?|gopher|ldap|dict|sftp|telnet|tftp):\/\/\[::1?\](?:[:/]|$)", "i"),
)
