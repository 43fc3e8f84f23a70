"""Outgoing text: the patterns that are looked for, in order. Fixed values, as JavaScript regular expressions."""

#: (id, severity, sub-category, title, description, expression, flags)
PATTERNS = (
    ("exfil.kv_credential", "critical", "credential_leak", "凭证出现在外发请求中", "",
     r"(?:api[_-]?key|token|secret|password|passwd|credential|auth)\s*[=:]\s*\S{8,}", "i"),
    ("exfil.aws_key", "critical", "credential_leak", "AWS Access Key 出现在请求中", "",
     r"(?:AKIA|ABIA|ACCA|ASIA)[0-9A-Z]{16}", ""),
    ("exfil.github_token", "critical", "credential_leak", "GitHub Token 出现在请求中", "",
     r"(?:ghp|gho|ghu|ghs|ghr|github_pat)_[A-Za-z0-9_]{36,}", "i"),
    ("exfil.openai_key", "critical", "credential_leak", "OpenAI API Key 出现在请求中", "",
     r"\bsk-[a-zA-Z0-9_-]{32,}", "i"),
    ("exfil.stripe_key", "critical", "credential_leak", "Stripe API Key 出现在请求中", "",
     r"\bsk_(?:live|test)_[a-zA-Z0-9]{20,}", "i"),
    ("exfil.anthropic_key", "critical", "credential_leak", "Anthropic API Key 出现在请求中", "",
     r"sk-ant-[a-zA-Z0-9_-]{20,}", "i"),
    ("exfil.google_key", "critical", "credential_leak", "Google API Key 出现在请求中", "",
     r"AIzaSy[a-zA-Z0-9_-]{33}", ""),
    ("exfil.slack_token", "critical", "credential_leak", "Slack Token 出现在请求中", "",
     r"xox[bpsar]-[0-9a-zA-Z-]{20,}", ""),
    ("exfil.private_key_pem", "critical", "credential_leak", "私钥出现在请求中", "",
     r"-----BEGIN\s+(RSA\s+|OPENSSH\s+)?PRIVATE\s+KEY-----", "i"),
    ("exfil.gitlab_pat", "critical", "credential_leak", "GitLab Personal Access Token 出现在请求中", "",
     r"\bglpat-[A-Za-z0-9_-]{20,}", ""),
    ("exfil.npm_token", "critical", "credential_leak", "NPM Token 出现在请求中", "",
     r"\bnpm_[A-Za-z0-9]{36,}", ""),
    ("exfil.pypi_token", "critical", "credential_leak", "PyPI Token 出现在请求中", "",
     r"\bpypi-[A-Za-z0-9_-]{16,}", ""),
    ("exfil.hf_token", "critical", "credential_leak", "HuggingFace Token 出现在请求中", "",
     r"\bhf_[A-Za-z0-9]{20,}", ""),
    ("exfil.sendgrid_key", "critical", "credential_leak", "SendGrid API Key 出现在请求中", "",
     r"\bSG\.[A-Za-z0-9_-]{22,}\.[A-Za-z0-9_-]{22,}", ""),
    ("exfil.do_token", "critical", "credential_leak", "DigitalOcean Token 出现在请求中", "",
     r"\bdop_v1_[a-f0-9]{64}", ""),
    ("exfil.vault_token", "critical", "credential_leak", "HashiCorp Vault Token 出现在请求中", "",
     r"\bhvs\.[A-Za-z0-9_-]{20,}", ""),
    ("exfil.jwt", "high", "credential_leak", "JWT Token 出现在请求中", "",
     r"\beyJ[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}", ""),
    ("exfil.mongodb_uri", "critical", "credential_leak", "MongoDB 连接字符串泄漏", "",
     r"mongodb(?:\+srv)?:\/\/[a-zA-Z0-9_-]+:[^\s@]+@[^\s;]+", "i"),
    ("exfil.slack_app_token", "critical", "credential_leak", "Slack App Token 出现在请求中", "",
     r"\bxapp-[0-9]-[A-Za-z0-9_-]{30,}", ""),
    ("exfil.mysql_uri", "critical", "credential_leak", "MySQL 连接字符串泄漏", "",
     r"mysql:\/\/[a-zA-Z0-9_-]+:[^\s@]+@[^\s;]+", "i"),
    ("exfil.postgres_uri", "critical", "credential_leak", "PostgreSQL 连接字符串泄漏", "",
     r"postgres(?:ql)?:\/\/[a-zA-Z0-9_-]+:[^\s@]+@[^\s;]+", "i"),
    ("exfil.redis_uri", "critical", "credential_leak", "Redis 连接字符串泄漏", "",
     r"rediss?:\/\/[a-zA-Z0-9_-]*:[^\s@]+@[^\s;]+", "i"),
    ("exfil.base64_blob", "medium", "encoded_exfil", "Base64 编码数据外发", "",
     r"""(?<=\s|^|["'`])[A-Za-z0-9+/\-_]{40,16000}={0,2}(?=\s|$|["'`])""", ""),
    ("exfil.curl_upload_local", "high", "file_upload", "通过 curl 上传本地文件", "",
     r"curl\s+.*-[dX]\s+.*@[~.]?\/", "i"),
    ("exfil.curl_data_binary", "high", "file_upload", "通过 curl 二进制上传文件", "",
     r"curl\s+.*--data-binary\s+@", "i"),
    ("exfil.curl_upload_file", "high", "file_upload", "通过 curl 上传文件", "",
     r"curl\s+.*--upload-file\s+", "i"),
    ("exfil.curl_multipart", "high", "file_upload", "通过 curl multipart 上传本地文件", "",
     r"curl\s+.*-F\s+.*@[~.]?\/", "i"),
    ("exfil.curl_dash_t", "high", "file_upload", "通过 curl -T 上传文件", "",
     r"curl\s+.*-T\s+", "i"),
    ("exfil.curl_json_file", "high", "file_upload", "通过 curl --json 上传文件", "",
     r"curl\s+.*--json\s+@", "i"),
    ("exfil.ftp", "high", "file_upload", "通过 FTP 传输数据", "",
     r"\bftp\s+.*-[snp]", "i"),
    ("exfil.env_var_then_url", "critical", "env_leak", "环境变量凭证与 URL 组合外发", "",
     r"\$\{?\w*(KEY|SECRET|TOKEN|PASSWORD|CREDENTIAL)\w*\}?.*https?:\/\/", "i"),
    ("exfil.url_then_env_var", "critical", "env_leak", "凭证嵌入 URL 参数", "",
     r"https?:\/\/.*\$\{?\w*(KEY|SECRET|TOKEN|PASSWORD|CREDENTIAL)\w*\}?", "i"),
    ("exfil.wget_post_file", "high", "file_upload", "通过 wget 上传文件", "",
     r"wget\s+.*--post-file[=\s]", "i"),
    ("exfil.wget_body_file", "high", "file_upload", "通过 wget --body-file 上传文件", "",
     r"wget\s+.*--body-file[=\s]", "i"),
    ("exfil.rclone", "high", "file_upload", "通过 rclone 传输到云存储", "",
     r"\brclone\s+(?:copy|sync|move|mount)\s", "i"),
    ("exfil.telegram_bot", "critical", "exfil_destination", "通过 Telegram Bot 发送数据", "",
     r"api\.telegram\.org\/bot[A-Za-z0-9_:-]+\/send", "i"),
    ("exfil.discord_webhook", "critical", "exfil_destination", "通过 Discord Webhook 发送数据", "",
     r"discord(?:app)?\.com\/api\/webhooks\/", "i"),
    ("exfil.read_sensitive_pipe_net", "critical", "pipe_exfil", "读取敏感文件并通过网络发送", "",
     r"(?:cat|head|tail|dd|strings|base64|xxd|tac|nl|less|more)\s+.*\.(pem|key|env|credentials|secret).*\|\s*(curl|wget|nc|ncat)", "i"),
    ("exfil.redirect_sensitive_net", "critical", "pipe_exfil", "将敏感文件重定向到网络工具", "",
     r"(curl|wget|nc)\s+.*<\s*.*\.(pem|key|env|credentials|secret)", "i"),
    ("exfil.redirect_cred_dir_nc", "critical", "pipe_exfil", "凭证文件重定向到 netcat", "",
     r"(nc|ncat)\s+\S+\s+\d+\s*<\s*.*~?\/?\.(?:ssh|aws|gnupg|config\/gcloud|docker|kube)\/", "i"),
    ("exfil.read_cred_dir_pipe_net", "critical", "pipe_exfil", "读取凭证文件并通过网络发送", "",
     r"(?:cat|head|tail|dd|strings|base64|xxd|tac|nl|less|more)\s+.*~?\/?\.(?:ssh|aws|gnupg|config\/gcloud|docker|kube)\/(id_rsa|id_ed25519|credentials|config|private-keys).*\|\s*(curl|wget|nc|ncat)", "i"),
    ("exfil.cmdsubst_sensitive_file", "critical", "pipe_exfil", "通过命令替换外泄敏感文件", "",
     r"(?:curl|wget)\s+.*\$\(\s*(?:cat|head|tail|base64|strings|xxd)\s+.*\.(pem|key|env|credentials|secret)\b", "i"),
    ("exfil.cmdsubst_cred_file", "critical", "pipe_exfil", "通过命令替换外泄凭证文件", "",
     r"(?:curl|wget)\s+.*\$\(\s*(?:cat|head|tail|base64|strings|xxd)\s+.*~?\/?\.(?:ssh|aws|gnupg|config\/gcloud|docker|kube)\/(id_rsa|id_ed25519|credentials|config|private-keys)\b", "i"),
    ("exfil.gpg_pipe_net", "critical", "pipe_exfil", "GPG 私钥导出并通过网络发送", "",
     r"gpg\s+.*--export-secret-keys.*\|\s*(curl|wget|nc|ncat)", "i"),
    ("exfil.scp_cred", "critical", "pipe_exfil", "通过 scp 外泄凭证文件", "",
     r"\bscp\s+.*~?\/?\.(?:ssh|aws|gnupg|config\/gcloud|docker|kube)\/", "i"),
    ("exfil.archive_pipe_net", "critical", "pipe_exfil", "通过 tar/zip 管道外泄凭证", "",
     r"\b(tar|zip)\s+.*~?\/?\.(?:ssh|aws|gnupg|config\/gcloud|docker|kube)\b.*\|\s*(curl|wget|nc|ncat)", "i"),
    ("exfil.rsync_cred", "critical", "pipe_exfil", "通过 rsync 外泄凭证文件", "",
     r"\brsync\s+.*~?\/?\.(?:ssh|aws|gnupg|config\/gcloud|docker|kube)\/", "i"),
    ("exfil.sftp_cred", "critical", "pipe_exfil", "通过 sftp 外泄凭证文件", "",
     r"\bsftp\s+.*~?\/?\.(?:ssh|aws|gnupg|config\/gcloud|docker|kube)\/", "i"),
    ("exfil.read_sensitive_pipe_socat", "critical", "pipe_exfil", "通过 socat/openssl 外泄敏感文件", "",
     r"(?:cat|head|tail|dd|strings|base64|xxd|tac|nl|less|more)\s+.*\.(pem|key|env|credentials|secret).*\|\s*(socat|openssl)", "i"),
    ("exfil.redirect_sensitive_socat", "critical", "pipe_exfil", "将敏感文件重定向到 socat/openssl", "",
     r"(socat|openssl\s+s_client)\s+.*<\s*.*\.(pem|key|env|credentials|secret)", "i"),
    ("exfil.read_cred_pipe_socat", "critical", "pipe_exfil", "通过 socat/openssl 外泄凭证文件", "",
     r"(?:cat|head|tail|dd|strings|base64|xxd|tac|nl|less|more)\s+.*~?\/?\.(?:ssh|aws|gnupg|config\/gcloud|docker|kube)\/(id_rsa|id_ed25519|credentials|config|private-keys).*\|\s*(socat|openssl)", "i"),
    ("exfil.dev_tcp_udp_write", "critical", "pipe_exfil", "通过 /dev/tcp|udp 外泄数据", "",
     r">\s*\/dev\/(?:tcp|udp)\/\S+\/\d+", "i"),
    ("exfil.cred_hex_encode", "critical", "pipe_exfil", "凭证转十六进制编码外泄", "",
     r"(?:cat|grep|sed|awk|cut|strings)\s+.*~?\/?\.(?:ssh|aws|gnupg|config\/gcloud|docker|kube)\b.*\|\s*(?:xxd|hexdump|od\b)", "i"),
    ("exfil.k8s_token_exfil", "critical", "pipe_exfil", "Kubernetes Service Account Token 外泄", "",
     r"(?:cat|head|tail|base64|strings)\s+.*\/var\/run\/secrets\/kubernetes\.io\/.*\|\s*(?:curl|wget|nc|ncat|socat)", "i"),
    ("exfil.env_enum_exfil", "critical", "pipe_exfil", "环境变量枚举后外泄", "",
     r"\b(?:env|printenv|set)\b.*\|\s*(?:grep|sed|awk|cut)\s+.*(?:KEY|SECRET|TOKEN|PASS|CRED).*\|\s*(?:curl|wget|nc|ncat)", "i"),
    ("exfil.dns_cmdsubst", "critical", "dns_exfil", "DNS 查询中嵌入命令替换（DNS 外泄）", "",
     r"(?:dig|nslookup|host)\s+.*\$\(.*\).*\.\S+", "i"),
    ("exfil.dns_backtick", "critical", "dns_exfil", "DNS 查询中嵌入反引号命令替换（DNS 外泄）", "",
     r"(?:dig|nslookup|host)\s+.*`[^`]+`.*\.\S+", "i"),
)

#: Known destinations; each counts only beside one of the CONDITIONS.
DESTINATIONS = (
    r"(?:^|[\s/.@])transfer\.sh(?:$|[\s/:?#])",
    r"(?:^|[\s/.@])file\.io(?:$|[\s/:?#])",
    r"(?:^|[\s/.@])0x0\.st(?:$|[\s/:?#])",
    r"(?:^|[\s/.@])paste\.ee(?:$|[\s/:?#])",
    r"\bhastebin\b",
    r"\brequestbin\b",
    r"(?:^|[\s/.@])webhook\.site(?:$|[\s/:?#])",
    r"\bhookbin\b",
    r"(?:^|[\s/.@])ngrok\.io(?:$|[\s/:?#])",
    r"(?:^|[\s/.@])ngrok-free\.app(?:$|[\s/:?#])",
    r"\bburpcollaborator\b",
    r"(?:^|[\s/.@])interact\.sh(?:$|[\s/:?#])",
    r"\bpipedream\.net\b",
    r"(?:^|[\s/.@])ix\.io(?:$|[\s/:?#])",
    r"(?:^|[\s/.@])sprunge\.us(?:$|[\s/:?#])",
    r"(?:^|[\s/.@])termbin\.com(?:$|[\s/:?#])",
    r"\boastify\.com\b",
    r"(?:^|[\s/.@])api\.telegram\.org(?:$|[\s/:?#])",
    r"(?:^|[\s/.@])discord(?:app)?\.com\/api\/webhooks(?:$|[\s/:?#])",
)
#: A send verb, command substitution, a sensitive query parameter: (expression, flags)
CONDITIONS = (
    (r"""(?:POST|PUT|PATCH|upload|send|--data(?:-raw|-urlencode)?|--form|--upload-file|--post-file|--post-data|--body-file|--json|-d[\s@"']|-F[\s@"']|-T\s|-XPOST|-XPUT)""", "i"),
    (r"\$\([^)]+\)|`[^`]+`|\$\{[^}]+\}", ""),
    (r"\?\S*(?:data|secret|token|key|passwd|password|credential|file)=", "i"),
)
DESTINATION_TITLE = "向已知外泄目标发送数据"
