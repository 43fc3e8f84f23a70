"""Paths: the patterns that are looked for, in order. Fixed values, as JavaScript regular expressions."""

#: (id, severity, sub-category, title, description, expression, flags)
PATTERNS = (
    ("path.ssh_key_files", "critical", "credentials", "SSH 密钥/配置访问", "",
     r"[/\\]\.ssh[/\\](id_rsa|id_ed25519|id_ecdsa|id_dsa|known_hosts|authorized_keys|config)", "i"),
    ("path.ssh_dir", "high", "credentials", "SSH 目录访问", "",
     r"[/\\]\.ssh[/\\]", "i"),
    ("path.aws_creds", "critical", "credentials", "AWS 凭证访问", "",
     r"[/\\]\.aws[/\\](credentials|config)", "i"),
    ("path.azure_dir", "high", "credentials", "Azure 配置访问", "",
     r"[/\\]\.azure[/\\]", "i"),
    ("path.gcloud_dir", "high", "credentials", "GCloud 配置访问", "",
     r"[/\\]\.config[/\\]gcloud[/\\]", "i"),
    ("path.dotenv", "high", "credentials", ".env 文件访问", "",
     r"[/\\]\.env(\.\w+)?\b", "i"),
    ("path.netrc", "high", "credentials", ".netrc 凭证访问", "",
     r"[/\\]\.netrc\b", "i"),
    ("path.npmrc", "high", "credentials", ".npmrc 访问（含 registry 配置和 auth token）", "",
     r"[/\\]\.npmrc\b", "i"),
    ("path.pgpass", "high", "credentials", "PostgreSQL 密码文件访问", "",
     r"[/\\]\.pgpass\b", "i"),
    ("path.my_cnf", "high", "credentials", "MySQL 配置文件访问", "",
     r"[/\\]\.my\.cnf\b", "i"),
    ("path.vault_token", "high", "credentials", "HashiCorp Vault Token 访问", "",
     r"[/\\]\.vault-token\b", "i"),
    ("path.terraform_token", "high", "credentials", "Terraform Cloud Token 访问", "",
     r"[/\\]\.terraform\.d[/\\]credentials\.tfrc\.json", "i"),
    ("path.consul_nomad", "high", "credentials", "HashiCorp Consul/Nomad Token 访问", "",
     r"[/\\]\.consul[/\\]|[/\\]\.nomad[/\\]", "i"),
    ("path.pypirc", "high", "credentials", "PyPI 凭证访问", "",
     r"[/\\]\.pypirc\b", "i"),
    ("path.pip_conf", "high", "credentials", "pip 配置访问（含 index URL）", "",
     r"[/\\]pip\.conf\b", "i"),
    ("path.pip_ini", "high", "credentials", "pip 配置访问（含 index URL）", "",
     r"[/\\]pip\.ini\b", "i"),
    ("path.gem_creds", "high", "credentials", "RubyGems 凭证访问", "",
     r"[/\\]\.gem[/\\]credentials\b", "i"),
    ("path.gradle", "high", "credentials", "Gradle 凭证访问", "",
     r"[/\\]\.gradle[/\\]gradle\.properties\b", "i"),
    ("path.maven", "high", "credentials", "Maven 仓库凭证访问", "",
     r"[/\\]\.m2[/\\]settings\.xml\b", "i"),
    ("path.git_credentials", "critical", "credentials", "Git HTTP 凭证文件访问", "",
     r"[/\\]\.git-credentials\b", "i"),
    ("path.gnupg", "high", "credentials", "GPG 密钥环访问", "",
     r"[/\\]\.gnupg[/\\]", "i"),
    ("path.k8s_sa_token", "critical", "credentials", "Kubernetes ServiceAccount Token 访问", "",
     r"[/\\]var[/\\]run[/\\]secrets[/\\]kubernetes\.io[/\\]", "i"),
    ("path.cargo_creds", "high", "credentials", "Cargo 仓库凭证访问", "",
     r"[/\\]\.cargo[/\\]credentials", "i"),
    ("path.chromium_data", "critical", "browser", "Chromium 浏览器数据访问", "",
     r"[/\\](Chrome|Chromium|Google Chrome|BraveSoftware|Brave-Browser|Microsoft Edge|Opera|Vivaldi)[/\\].*?\b(Login Data|Cookies|History|Web Data)\b", "i"),
    ("path.firefox_data", "critical", "browser", "Firefox 浏览器数据访问", "",
     r"[/\\](Firefox|Mozilla)[/\\].*?\b(logins\.json|cookies\.sqlite|key[34]\.db)\b", "i"),
    ("path.safari_data", "critical", "browser", "Safari 浏览器数据访问", "",
     r"[/\\]Safari[/\\].*?\b(Cookies\.binarycookies|History\.db)\b", "i"),
    ("path.macos_cookies", "critical", "browser", "macOS Cookie 数据库访问", "",
     r"[/\\](?:Library|Caches)[/\\].*?Cookies\.binarycookies\b", "i"),
    ("path.proc_environ_mem_cmdline", "critical", "system", "Linux /proc 敏感文件访问", "",
     r"[/\\]proc[/\\](?:self|\d+)[/\\](environ|mem|cmdline)", "i"),
    ("path.proc_root", "critical", "system", "Linux /proc/root 文件系统遍历", "",
     r"[/\\]proc[/\\](?:self|\d+)[/\\]root[/\\]", "i"),
    ("path.proc_info", "high", "system", "Linux /proc 信息泄露", "",
     r"[/\\]proc[/\\](?:self|\d+)[/\\](fd|maps|smaps|status|stat|io|net|cwd|exe)\b", "i"),
    ("path.etc_auth", "high", "system", "系统认证文件访问", "",
     r"[/\\]etc[/\\](passwd|shadow|sudoers|master\.passwd)", "i"),
    ("path.macos_security_prefs", "high", "system", "macOS 安全偏好访问", "",
     r"[/\\]Library[/\\]Preferences[/\\]com\.apple\.security", "i"),
    ("path.bitcoin_wallet", "critical", "crypto_wallet", "Bitcoin 钱包访问", "",
     r"[/\\]\.bitcoin[/\\]wallet\.dat", "i"),
    ("path.ethereum_keystore", "critical", "crypto_wallet", "Ethereum 密钥库访问", "",
     r"[/\\]\.ethereum[/\\]keystore[/\\]", "i"),
    ("path.kube_config", "high", "credentials", "Kubernetes 配置访问", "",
     r"[/\\]\.kube[/\\]config", "i"),
    ("path.docker_config", "high", "credentials", "Docker 配置访问", "",
     r"[/\\]\.docker[/\\]config\.json", "i"),
    ("path.run_secrets", "critical", "credentials", "Docker Swarm 密钥访问", "",
     r"[/\\]run[/\\]secrets[/\\]", "i"),
    ("path.ssl_private", "critical", "credentials", "SSL 私钥目录访问", "",
     r"[/\\]etc[/\\]ssl[/\\]private[/\\]", "i"),
    ("path.filezilla", "high", "credentials", "FileZilla 保存密码访问", "",
     r"[/\\]\.?config[/\\]filezilla[/\\]", "i"),
    ("path.winscp", "high", "credentials", "WinSCP 会话数据访问", "",
     r"[/\\]WinSCP\.ini\b", "i"),
    ("path.macos_keychain", "critical", "credentials", "macOS 钥匙串访问", "",
     r"[/\\]Keychains[/\\].*\.(keychain-db|keychain)", "i"),
    ("path.gnome_keyring", "critical", "credentials", "GNOME 密钥环访问", "",
     r"[/\\]\.local[/\\]share[/\\]keyrings[/\\]", "i"),
    ("path.keepass", "critical", "credentials", "KeePass 密码数据库访问", "",
     r"[/\\][^/\\]*\.kdbx?\b", "i"),
    ("path.heroku", "high", "credentials", "Heroku CLI 凭证访问", "",
     r"[/\\]\.config[/\\]heroku[/\\]", "i"),
    ("path.stripe", "high", "credentials", "Stripe CLI 凭证访问", "",
     r"[/\\]\.config[/\\]stripe[/\\]", "i"),
    ("path.doctl", "high", "credentials", "DigitalOcean CLI 凭证访问", "",
     r"[/\\]\.config[/\\]doctl[/\\]", "i"),
    ("path.hub_cli", "high", "credentials", "Hub CLI Token 访问", "",
     r"[/\\]\.config[/\\]hub\b", "i"),
    ("path.onepassword_cli", "high", "credentials", "1Password CLI 配置访问", "",
     r"[/\\]\.config[/\\]op[/\\]", "i"),
    ("path.teleport", "high", "credentials", "Teleport SSH 凭证访问", "",
     r"[/\\]\.tsh[/\\]", "i"),
    ("path.windows_sam", "critical", "credentials", "Windows 凭证存储访问", "",
     r"[/\\]Windows[/\\]System32[/\\]config[/\\](SAM|SECURITY|SYSTEM)", "i"),
    ("path.windows_credman", "critical", "credentials", "Windows 凭证管理器访问", "",
     r"[/\\]Microsoft[/\\]Credentials[/\\]", "i"),
    ("path.aws_sso", "critical", "credentials", "AWS SSO 缓存 Token 访问", "",
     r"[/\\]\.aws[/\\]sso[/\\]", "i"),
    ("path.aliyun", "critical", "credentials", "阿里云凭证访问", "",
     r"[/\\]\.aliyun[/\\](?:config|credentials)\b", "i"),
    ("path.tencentcloud", "critical", "credentials", "腾讯云凭证访问", "",
     r"[/\\]\.tencentcloud[/\\]", "i"),
    ("path.huaweicloud", "high", "credentials", "华为云凭证访问", "",
     r"[/\\]\.huaweicloud[/\\]", "i"),
    ("path.tfstate", "high", "credentials", "Terraform 状态文件访问", "",
     r"[/\\]terraform\.tfstate(?:\.backup)?\b", "i"),
    ("path.htpasswd", "high", "credentials", "Apache 密码文件访问", "",
     r"[/\\]\.htpasswd\b", "i"),
    ("path.macos_tcc", "critical", "system", "macOS TCC 隐私数据库访问", "",
     r"[/\\]TCC\.db\b", "i"),
    ("path.wireguard", "high", "credentials", "WireGuard 配置访问", "",
     r"[/\\]wireguard[/\\].*\.conf\b", "i"),
    ("path.openvpn", "high", "credentials", "OpenVPN 配置访问", "",
     r"[/\\]openvpn[/\\]", "i"),
    ("path.solana", "critical", "crypto_wallet", "Solana 钱包访问", "",
     r"[/\\]\.config[/\\]solana[/\\]", "i"),
    ("path.monero", "critical", "crypto_wallet", "Monero 钱包访问", "",
     r"[/\\]\.bitmonero[/\\]", "i"),
    ("path.gitlab_runner", "critical", "credentials", "GitLab Runner 凭证访问", "",
     r"[/\\]\.cache[/\\]gitlab-runner[/\\]", "i"),
    ("path.gh_cli", "high", "credentials", "GitHub CLI 凭证访问", "",
     r"[/\\]\.config[/\\]gh[/\\]hosts\.yml\b", "i"),
    ("path.yarnrc", "medium", "credentials", ".yarnrc 访问（可能含 token）", "",
     r"[/\\]\.yarnrc(?:\.yml)?\b", "i"),
    ("path.shell_history", "high", "credentials", "Shell/REPL 历史文件访问", "",
     r"[/\\]\.(?:bash_history|zsh_history|sh_history|python_history|node_repl_history|mysql_history|psql_history|rediscli_history)\b", "i"),
    ("path.envrc", "high", "credentials", ".envrc 文件访问（direnv）", "",
     r"[/\\]\.envrc\b", "i"),
    ("path.signal", "high", "credentials", "Signal 本地数据访问", "",
     r"[/\\](?:Signal|org\.signal)[/\\].*?(?:config\.json|sql[/\\]db\.sqlite)\b", "i"),
    ("path.discord", "high", "credentials", "Discord 本地数据访问", "",
     r"[/\\](?:discord|discordcanary)[/\\].*?(?:Local Storage|Session Storage|Cookies)\b", "i"),
    ("path.aws_cli_cache", "critical", "credentials", "AWS CLI 缓存 Token 访问", "",
     r"[/\\]\.aws[/\\]cli[/\\]cache[/\\]", "i"),
    ("path.etcd", "critical", "credentials", "etcd 数据目录访问", "",
     r"[/\\]var[/\\]lib[/\\]etcd[/\\]", "i"),
    ("path.ai_agent_config", "critical", "credentials", "AI Agent 配置目录访问", "",
     r"[/\\]\.(?:claude|cursor|codex|openclaw|gemini|copilot|windsurf|aider)[/\\]", "i"),
    ("path.docker_sock", "critical", "system", "Docker Socket 访问", "",
     r"[/\\]var[/\\]run[/\\]docker\.sock\b", "i"),
)
