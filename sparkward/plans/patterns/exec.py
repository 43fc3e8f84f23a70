"""Commands: the patterns that are looked for, in order. Fixed values, as JavaScript regular expressions."""

#: (id, severity, sub-category, title, description, expression, flags)
PATTERNS = (
    ("exec.rce_curl_pipe_shell", "critical", "", "远程代码执行：curl 管道到 shell", "下载并立即执行远程代码，这是恶意软件安装的头号向量。",
     r"(?:\/[\w.+-]+\/)*curl\s.*\|.*\b(sh|bash|zsh|dash|ksh|fish|csh|tcsh|ash|mksh|pwsh|python[23]?|ruby|node|perl)\b", "i"),
    ("exec.rce_wget_pipe_shell", "critical", "", "远程代码执行：wget 管道到 shell", "通过 wget 下载并立即执行远程代码。",
     r"(?:\/[\w.+-]+\/)*wget\s.*\|.*\b(sh|bash|zsh|dash|ksh|fish|csh|tcsh|ash|mksh|pwsh|python[23]?|ruby|node|perl)\b", "i"),
    ("exec.rce_process_subst", "critical", "", "远程代码执行：进程替换", "通过进程替换下载并执行远程代码——绕过管道检测的常见手法。",
     r"\b(bash|sh|zsh)\s*<\(\s*(curl|wget)\s", "i"),
    ("exec.rce_output_process_subst", "critical", "", "远程代码执行：输出进程替换", "通过输出进程替换下载并执行远程代码——绕过管道检测的手法。",
     r"(?:\/[\w.+-]+\/)*(?:curl|wget)\s.*>\s*>\(\s*(sh|bash|zsh|dash|ksh|fish|csh|tcsh|ash|mksh|pwsh|python[23]?|ruby|node|perl)\b", "i"),
    ("exec.b64_decode_pipe_shell", "critical", "", "编码载荷执行", "解码并执行 base64 编码命令——常见恶意软件混淆技术。",
     r"base64\s+(-[dD]|--decode)\s*\|\s*(sh|bash|eval)", "i"),
    ("exec.echo_b64_pipe_shell", "critical", "", "混淆命令执行", "echo 编码数据 → 解码 → 执行，经典代码注入模式。",
     r"echo\s.*\|\s*base64\s+(-[dD]|--decode)\s*\|\s*(sh|bash)", "i"),
    ("exec.eval_cmd_subst", "high", "", "动态 eval 执行", "eval 配合命令替换——可从动态源执行任意代码。",
     r"\beval\s*\$\(", "i"),
    ("exec.eval_string", "high", "", "eval 字符串执行", "eval 直接执行字符串变量——可能执行注入的代码。",
     r"""\beval\s+["'$]""", "i"),
    ("exec.eval_backtick", "high", "", "eval 反引号命令替换", "eval 配合反引号命令替换——可从动态源执行任意代码。",
     r"\beval\s*`", "i"),
    ("exec.shell_c_subst_download", "critical", "", "命令替换远程执行", "通过命令替换下载并执行远程代码。",
     r"""\b(bash|sh|zsh)\s+-c\s+["']?(?:\$\(|`)\s*(curl|wget)\b""", "i"),
    ("exec.source_process_subst", "critical", "", "进程替换 source 执行", "通过 source + 进程替换下载并执行远程代码。",
     r"\bsource\s*<\(\s*(curl|wget)\b", "i"),
    ("exec.dot_process_subst", "critical", "", "dot-source 进程替换执行", "通过 . (dot) + 进程替换下载并执行远程代码。",
     r"\.\s*<\(\s*(curl|wget)\b", "i"),
    ("exec.source_tmp_script", "high", "", "source 加载临时目录脚本", "通过 source 或 dot 加载临时目录中的脚本，可能为两步攻击（先写入再执行）。",
     r"(?:\bsource\b|\.\s)\s*(?:\/tmp\/|\/dev\/shm\/|\/var\/tmp\/)", "i"),
    ("exec.xargs_shell", "high", "", "xargs shell 执行", "通过 xargs 传递数据到 shell 执行。",
     r"\bxargs\s+.*\b(sh|bash|zsh)\b", "i"),
    ("exec.herestring_net_tool", "critical", "", "heredoc 注入执行", "通过 here-string 向 shell 注入包含网络工具的命令。",
     r"\b(bash|sh|zsh)\s+<<<\s*.*\b(curl|wget|nc|ncat)\b", "i"),
    ("exec.heredoc_shell", "high", "", "heredoc shell 注入", "通过 heredoc (<<) 向 shell 注入多行命令——可隐藏恶意载荷。",
     r"""\b(bash|sh|zsh)\s.*<<\s*['"]?\w+['"]?\s*($|\n|;\s)""", "i"),
    ("exec.cat_heredoc_pipe_shell", "critical", "", "cat heredoc 管道到 shell", "通过 cat heredoc 构建内容并管道到 shell 执行。",
     r"""\bcat\s*<<\s*['"]?\w+['"]?.*\|\s*(bash|sh|zsh)\b""", "i"),
    ("exec.read_ssh_key", "critical", "", "SSH 密钥访问", "尝试读取 SSH 私钥——潜在凭证窃取。",
     r"\b(cat|head|tail|less|more|strings|tac|nl)\s+.*~?\/?\.ssh\/(id_rsa|id_ed25519|id_ecdsa|authorized_keys)", "i"),
    ("exec.read_aws_creds", "critical", "", "AWS 凭证访问", "尝试读取 AWS 凭证——潜在云账户接管。",
     r"\b(cat|head|tail|less|more|strings|tac|nl)\s+.*~?\/?\.aws\/(credentials|config)", "i"),
    ("exec.read_private_key_file", "high", "", "私钥文件访问", "尝试读取私钥或证书文件。",
     r"\b(cat|head|tail|less|more|strings|tac|nl)\b.*\.(pem|key|p12|pfx|jks)\b", "i"),
    ("exec.read_gcp_creds", "critical", "", "GCP 凭证读取", "读取 Google Cloud 凭证文件。",
     r"\b(cat|head|tail|less|more|strings|tac|nl|grep|sed|awk|xxd|base64)\b.*~?\/?\.config\/gcloud\/", "i"),
    ("exec.read_kubeconfig", "high", "", "Kubernetes 配置读取", "读取 kubeconfig 文件——可能含嵌入凭证。",
     r"\b(cat|head|tail|less|more|strings|tac|nl|grep|sed|awk|xxd|base64)\b.*~?\/?\.kube\/config", "i"),
    ("exec.read_docker_config", "high", "", "Docker 凭证读取", "读取 Docker 仓库认证凭证。",
     r"\b(cat|head|tail|less|more|strings|tac|nl|grep|sed|awk|xxd|base64)\b.*~?\/?\.docker\/config\.json", "i"),
    ("exec.read_netrc", "critical", "", ".netrc 凭证读取", "读取 .netrc 文件——包含明文网络凭证。",
     r"\b(cat|head|tail|less|more|strings|tac|nl|grep|sed|awk|xxd|base64)\b.*~?\/?\.netrc", "i"),
    ("exec.git_credential_cmd", "critical", "", "Git 凭证操作", "通过 git credential 子命令提取或操纵存储的 HTTP 凭证。",
     r"\bgit\s+credential\s+(fill|approve|reject)\b", "i"),
    ("exec.read_git_credentials", "critical", "", "Git 凭证文件读取", "读取 .git-credentials 文件——包含明文 HTTP 凭证。",
     r"\b(cat|head|tail|less|more|strings|tac|nl|grep|sed|awk|xxd|base64)\b.*~?\/?\.git-credentials\b", "i"),
    ("exec.gpg_export_secret", "critical", "", "GPG 私钥导出", "导出 GPG 私钥——潜在凭证外泄。",
     r"\bgpg\s+.*--export-secret-keys", "i"),
    ("exec.macos_keychain_cli", "critical", "", "macOS 钥匙串密码读取", "通过 security 命令读取 macOS 钥匙串密码——凭证窃取。",
     r"\bsecurity\s+(?:find-generic-password|find-internet-password|dump-keychain)\b", "i"),
    ("exec.copy_ssh_key", "critical", "", "SSH 密钥复制/传输", "尝试复制或传输 SSH 私钥——潜在凭证外泄。",
     r"\b(cp|scp|rsync)\s+.*~?\/?\.ssh\/(id_rsa|id_ed25519|id_ecdsa|authorized_keys)", "i"),
    ("exec.copy_aws_creds", "critical", "", "AWS 凭证复制/传输", "尝试复制或传输 AWS 凭证——潜在云账户接管。",
     r"\b(cp|scp|rsync)\s+.*~?\/?\.aws\/(credentials|config)", "i"),
    ("exec.dd_ssh", "critical", "", "dd 读取 SSH 密钥", "通过 dd 读取 SSH 密钥文件——绕过常规文件读取检测。",
     r"\bdd\s+if=.*~?\/?\.ssh\/", "i"),
    ("exec.tar_ssh", "critical", "", "tar 打包 SSH 密钥", "通过 tar 打包 SSH 密钥目录——批量凭证外泄。",
     r"\btar\s+.*~?\/?\.ssh\/", "i"),
    ("exec.dd_aws", "critical", "", "dd 读取 AWS 凭证", "通过 dd 读取 AWS 凭证文件。",
     r"\bdd\s+if=.*~?\/?\.aws\/", "i"),
    ("exec.tar_aws", "critical", "", "tar 打包 AWS 凭证", "通过 tar 打包 AWS 凭证目录。",
     r"\btar\s+.*~?\/?\.aws\/", "i"),
    ("exec.zip_ssh", "critical", "", "zip 打包 SSH 密钥", "通过 zip 打包 SSH 密钥目录——批量凭证外泄。",
     r"\bzip\s+.*~?\/?\.ssh\/", "i"),
    ("exec.zip_aws", "critical", "", "zip 打包 AWS 凭证", "通过 zip 打包 AWS 凭证目录。",
     r"\bzip\s+.*~?\/?\.aws\/", "i"),
    ("exec.find_exec_ssh", "critical", "", "find -exec 搜索 SSH 密钥", "通过 find -exec 搜索并操作 SSH 密钥文件——凭证扫描。",
     r"\bfind\s+.*-(?:exec|ok)\s+.*~?\/?\.ssh\/", "i"),
    ("exec.find_credential_names", "critical", "", "find 搜索凭证文件", "通过 find 搜索凭证文件名——凭证发现与外泄。",
     r"\bfind\s+.*(?:id_rsa|id_ed25519|id_ecdsa|authorized_keys|credentials)\b.*-(?:exec|ok|print)", "i"),
    ("exec.find_root_delete", "critical", "", "find -delete 从根目录删除", "通过 find -delete 从根目录递归删除文件——绕过 rm 检测的破坏性操作。",
     r"\bfind\s+\/\s+.*?-delete\b", "i"),
    ("exec.env_pipe_net", "high", "", "环境变量外泄", "导出环境变量并发送到外部——可能泄露 API 密钥和密钥。",
     r"\b(env|printenv)\b.*\|\s*(curl|wget|nc|ncat)", "i"),
    ("exec.revshell_dev_tcp", "critical", "", "反弹 shell：/dev/tcp", "尝试通过 /dev/tcp 打开反弹 shell 或数据外泄通道。",
     r"\/dev\/tcp\/\S+\/\d+", "i"),
    ("exec.revshell_dev_udp", "critical", "", "反弹 shell：/dev/udp", "通过 /dev/udp 打开 UDP 反弹 shell 或数据外泄通道。",
     r"\/dev\/udp\/\S+\/\d+", "i"),
    ("exec.revshell_nc_exec", "critical", "", "反弹 shell：netcat exec", "尝试通过 netcat/ncat 打开反弹 shell。",
     r"\b(nc|ncat)\s+(-[ec]|--exec)\s", "i"),
    ("exec.revshell_mkfifo_nc", "critical", "", "反弹 shell：mkfifo + netcat", "尝试通过 mkfifo 管道和 netcat 打开反弹 shell。",
     r"\bmkfifo\b.*\b(nc|ncat)\b", "i"),
    ("exec.revshell_python_socket", "critical", "", "反弹 shell：python socket", "尝试通过 Python socket 打开反弹 shell。",
     r"""\bpython[23]?\s+.*?-c\s+['"].*\bsocket\b""", "i"),
    ("exec.revshell_ruby", "critical", "", "反弹 shell：ruby TCPSocket", "尝试通过 Ruby TCPSocket 打开反弹 shell。",
     r"\bruby\s+.*?-e\s+.*\b(TCPSocket|system|exec|IO\.popen)\b", "i"),
    ("exec.revshell_perl", "critical", "", "反弹 shell：perl socket/exec", "尝试通过 Perl socket/system/exec 执行系统命令或打开反弹 shell。",
     r"\bperl\s+.*?-e\s+.*\b(socket\s*\(|system\s*\(|exec\s*\(|open\s*\(.*\|)", "i"),
    ("exec.revshell_socat", "critical", "", "反弹 shell：socat exec", "尝试通过 socat 打开反弹 shell。",
     r"\bsocat\b.*\b(EXEC|SYSTEM):", "i"),
    ("exec.revshell_awk_inet", "critical", "", "反弹 shell：awk inet/tcp", "通过 awk 的 /inet/tcp 特性打开网络连接——反弹 shell 手法。",
     r"\bawk\b.*\binet\b.*\btcp\b", "i"),
    ("exec.revshell_node", "critical", "", "反弹 shell：Node.js child_process", "尝试通过 Node.js child_process 执行命令或打开反弹 shell。",
     r"\bnode\s+.*?-e\s+.*\bchild_process\b", "i"),
    ("exec.revshell_php", "critical", "", "反弹 shell：PHP fsockopen", "尝试通过 PHP fsockopen 打开反弹 shell。",
     r"\bphp\s+.*?-r\s+.*\b(fsockopen|system|exec|shell_exec|passthru|popen)\b", "i"),
    ("exec.revshell_telnet_pipe", "critical", "", "反弹 shell：telnet 管道", "尝试通过 telnet 管道打开反弹 shell。",
     r"\btelnet\s+\S+\s+\d+\s*\|.*\b(sh|bash)\b", "i"),
    ("exec.rm_rf_root", "critical", "", "从根目录递归强制删除", "尝试从根目录递归删除文件。",
     r"\brm\s+(-{1,2}[\w][\w=-]*\s+)*(-[rRfF]{2,}|-[rR]\s[^/]*-[fF]|-[fF]\s[^/]*-[rR]|--recursive\s[^/]*--force|--force\s[^/]*--recursive|-[rR]\s[^/]*--force|--force\s[^/]*-[rR]|-[fF]\s[^/]*--recursive|--recursive\s[^/]*-[fF])\s+\/(?:\s|$|\*)", "i"),
    ("exec.rm_rf_abs_path", "high", "", "递归强制删除绝对路径", "尝试从绝对路径递归删除文件——可能导致严重数据丢失。",
     r"\brm\s+(-{1,2}[\w][\w=-]*\s+)*(-[rRfF]{2,}|-[rR]\s[^/]*-[fF]|-[fF]\s[^/]*-[rR]|--recursive\s[^/]*--force|--force\s[^/]*--recursive|-[rR]\s[^/]*--force|--force\s[^/]*-[rR]|-[fF]\s[^/]*--recursive|--recursive\s[^/]*-[fF])\s+\/\w", "i"),
    ("exec.rm_rf_home", "high", "", "递归强制删除用户主目录", "尝试递归删除用户主目录。",
     r"\brm\s+(-{1,2}[\w][\w=-]*\s+)*(-[rRfF]{2,}|-[rR]\s[^~]*-[fF]|-[fF]\s[^~]*-[rR]|--recursive\s[^~]*--force|--force\s[^~]*--recursive|-[rR]\s[^~]*--force|--force\s[^~]*-[rR]|-[fF]\s[^~]*--recursive|--recursive\s[^~]*-[fF])\s+~(?:\s|$|\/)", "i"),
    ("exec.rm_no_preserve_root", "critical", "", "rm --no-preserve-root 绕过安全检查", "使用 --no-preserve-root 绕过 rm 的根目录删除保护——恶意删除手法。",
     r"\brm\s+.*--no-preserve-root\b", "i"),
    ("exec.disk_format_overwrite", "critical", "", "磁盘格式化/覆写", "尝试格式化磁盘或覆写设备文件。",
     r"\b(mkfs|dd\s+if=.*of=\/dev\/)", "i"),
    ("exec.nohup_net_shell", "high", "", "后台持久化网络操作", "通过 nohup 在后台运行网络工具——可能建立持久化连接。",
     r"\bnohup\b.*\b(curl|wget|nc|ncat|bash|sh)\b", "i"),
    ("exec.crontab_modify", "high", "", "crontab 修改", "尝试修改 crontab——可能建立持久化后门。",
     r"\bcrontab\s+(?!-l\b)", "i"),
    ("exec.shell_rc_write", "high", "", "shell 配置文件注入", "向 shell 配置文件写入或追加内容——可能建立持久化执行。",
     r">{1,2}\s*~?\/?\.(?:bashrc|bash_profile|zshrc|profile|zprofile)\b", "i"),
    ("exec.authorized_keys_write", "critical", "", "SSH authorized_keys 注入", "向 authorized_keys 写入或追加内容——可能建立未授权 SSH 访问。",
     r">{1,2}\s*~?\/?\.ssh\/authorized_keys\b", "i"),
    ("exec.authorized_keys_tee", "critical", "", "SSH authorized_keys 注入 (tee)", "通过 tee 向 authorized_keys 写入内容——建立未授权 SSH 访问。",
     r"\btee\s+(-a\s+)?~?\/?\.ssh\/authorized_keys\b", "i"),
    ("exec.shell_rc_tee", "high", "", "shell 配置文件注入 (tee)", "通过 tee 向 shell 配置文件写入内容——建立持久化。",
     r"\btee\s+(-a\s+)?~?\/?\.(?:bashrc|bash_profile|zshrc|profile|zprofile)\b", "i"),
    ("exec.systemctl_enable", "high", "", "systemd 服务启用", "启用 systemd 服务——可能建立持久化后门。",
     r"\bsystemctl\s+enable\b", "i"),
    ("exec.launchctl_load", "high", "", "macOS launchctl 服务注册", "通过 launchctl 注册持久化服务——macOS 等效于 systemctl enable。",
     r"\blaunchctl\s+(load|submit)\b", "i"),
    ("exec.escape_nsenter", "critical", "", "容器逃逸：nsenter", "使用 nsenter 进入主机命名空间——容器逃逸手法。",
     r"\bnsenter\s+(-t|--target)\s", "i"),
    ("exec.escape_chroot_proc", "critical", "", "容器逃逸：chroot /proc/root", "通过 chroot /proc/self/root 逃逸容器——获取宿主机文件系统访问。",
     r"\bchroot\s+\/proc\/(?:self|\d+)\/root\b", "i"),
    ("exec.escape_unshare", "critical", "", "命名空间逃逸：unshare", "使用 unshare 创建新命名空间——潜在容器逃逸或特权提升。",
     r"\bunshare\s+(-[a-zA-Z]|--\w+)\s", "i"),
    ("exec.privesc_pkexec", "critical", "", "特权提升：pkexec", "使用 pkexec 以 root 身份执行命令——特权提升向量（CVE-2021-4034）。",
     r"\bpkexec\s", "i"),
    ("exec.docker_privileged", "critical", "", "特权容器启动", "启动特权容器——拥有完整主机访问权限。",
     r"\bdocker\s+run\s+.*--privileged", "i"),
    ("exec.docker_mount_root", "critical", "", "Docker 挂载主机根目录", "将主机根目录挂载到容器——完全主机访问。",
     r"\bdocker\s+run\s+.*(-v|--volume)\s+\/:\/[a-z]", "i"),
    ("exec.kernel_module_load", "critical", "", "内核模块加载", "加载内核模块——可能安装 rootkit。",
     r"\b(insmod|modprobe)\s", "i"),
    ("exec.suid_symbolic", "critical", "", "SUID 位设置", "设置 SUID 位——特权提升。",
     r"\bchmod\s+[ugoa]*[+=][rwx]*s[rwx]*\b", "i"),
    ("exec.suid_numeric", "critical", "", "SUID/SGID 位设置（数字模式）", "通过数字权限设置 SUID/SGID 位——特权提升。",
     r"\bchmod\s+0?[2-7]\d{3}\b", "i"),
    ("exec.chmod_reference", "high", "", "chmod --reference 权限复制", "通过 --reference 复制其他文件的权限——可能复制 SUID/SGID 位。",
     r"\bchmod\s+--reference[=\s]", "i"),
    ("exec.acl_modify", "high", "", "ACL 权限修改", "修改文件 ACL 权限——可能绕过传统权限限制。",
     r"\bsetfacl\s+.*-m\s", "i"),
    ("exec.chattr_immutable", "high", "", "文件不可变标志设置", "设置文件不可变标志——可用于保护恶意文件不被删除。",
     r"\bchattr\s+.*\+i\b", "i"),
    ("exec.setcap", "critical", "", "Linux capabilities 设置", "通过 setcap 授予文件特权 capabilities——可用于特权提升。",
     r"\bsetcap\s+cap_\w+", "i"),
    ("exec.install_suid", "critical", "", "install 命令设置 SUID/SGID 位", "通过 install 命令复制文件并设置 SUID/SGID 位——特权提升。",
     r"\binstall\s+.*-m\s*0?[2-7]\d{3}\b", "i"),
    ("exec.ld_preload_env", "high", "", "LD_PRELOAD/LD_LIBRARY_PATH 注入", "通过 LD_PRELOAD 或 LD_LIBRARY_PATH 注入共享库——代码注入和特权提升。",
     r"\bLD_(?:PRELOAD|LIBRARY_PATH)=", "i"),
    ("exec.dyld_insert_env", "high", "", "macOS DYLD_INSERT_LIBRARIES 注入", "通过 DYLD_INSERT_LIBRARIES 注入动态库——macOS 等效于 LD_PRELOAD。",
     r"\bDYLD_INSERT_LIBRARIES=", "i"),
    ("exec.ld_so_preload_append", "critical", "", "/etc/ld.so.preload 注入", "向 /etc/ld.so.preload 追加共享库——系统级持久化后门。",
     r">>\s*\/etc\/ld\.so\.preload\b", "i"),
    ("exec.mount_options", "high", "", "文件系统挂载", "挂载文件系统——可能挂载恶意存储或暴露宿主文件。",
     r"\bmount\s+.*(-o|--options)\s", "i"),
    ("exec.firewall_modify", "high", "", "防火墙规则修改", "修改防火墙规则——可能打开网络通道或阻止安全监控。",
     r"\b(iptables|ip6tables|nftables|nft)\s+.*(-A|-I|-D|add|insert|delete)\s", "i"),
    ("exec.download_then_interpret", "critical", "", "下载到文件后执行", "通过 curl/wget 下载到文件后直接用 shell/解释器执行——绕过管道检测的变体。",
     r"(curl|wget)\s+.*?-[oO]\s+(\S+).*?(?:&&|[;&])\s*(sh|bash|zsh|dash|python[23]?|ruby|node|perl)\s+\2(?=\s|$)", "i"),
    ("exec.chmod_x_then_run", "high", "", "下载后赋权执行", "赋予文件执行权限后立即运行——常见恶意软件安装模式。",
     r"chmod\s+\+x\s+.*&&\s*\.?\/", "i"),
    ("exec.download_chmod_x", "high", "", "下载文件后赋权执行", "通过 curl/wget 下载文件后赋予执行权限——恶意软件安装模式。",
     r"(curl|wget)\s+.*-[oO]\s+\S+.*&&.*chmod\s+\+x", "i"),
    ("exec.curl_data_cmd_subst", "high", "", "HTTP 数据外泄", "通过 HTTP POST 发送命令输出——潜在数据外泄。",
     r"curl\s+.*(-d|--data|--data-binary)\s.*\$\(", "i"),
    ("exec.env_interpreter", "high", "", "通过 env 调用解释器", "使用 env 命令执行解释器——可绕过受限 PATH 环境。",
     r"\benv\s+(-\S+\s+)*(sh|bash|zsh|dash|ksh|python[23]?|ruby|node|perl)\s+-[ce]\s", "i"),
    ("exec.curl_pipe_busybox", "critical", "", "远程代码执行：curl 管道到 busybox shell", "通过 busybox shell 执行远程下载代码——容器/嵌入式常见绕过手法。",
     r"(?:\/[\w.+-]+\/)*curl\s.*\|\s*busybox\s+(sh|ash|bash)\b", "i"),
    ("exec.busybox_download_pipe", "critical", "", "远程代码执行：busybox 下载并管道执行", "通过 busybox 内置网络工具下载并执行远程代码。",
     r"busybox\s+(wget|curl)\s.*\|\s*(sh|ash|bash|busybox\s+sh)\b", "i"),
    ("exec.python_inline_system", "critical", "", "Python 内联系统命令执行", "通过 Python -c 内联执行系统命令或动态导入——常见绕过手法。",
     r"""\bpython[23]?\s+.*?-c\s+['"].*\b(os\.system|subprocess|__import__)\b""", "i"),
    ("exec.python_inline_network", "high", "", "Python 内联网络请求", "通过 Python -c 内联发起网络请求——潜在远程代码下载。",
     r"""\bpython[23]?\s+.*?-c\s+['"].*\b(urllib|requests|urlopen)\b""", "i"),
    ("exec.python_http_server", "high", "", "Python HTTP 服务器", "启动 Python HTTP 服务器——可对外暴露本地文件。",
     r"\bpython[23]?\s+.*?-m\s+http\.server\b", "i"),
    ("exec.python_inline_exec_pty", "critical", "", "Python 内联 exec/pty 执行", "通过 Python -c 使用 exec()/compile()/pty.spawn() 执行任意代码。",
     r"""\bpython[23]?\s+.*?-c\s+['"].*?\b(exec|compile|pty\.spawn)\b""", "i"),
    ("exec.python_deserialize", "critical", "", "Python 反序列化代码执行", "通过 pickle/marshal/yaml 反序列化未信任数据——任意代码执行向量。",
     r"""\bpython[23]?\s+.*?-c\s+['"].*?\b(?:pickle\.loads|marshal\.loads|yaml\.(?:unsafe_)?load)\b""", "i"),
    ("exec.update_alternatives_interp", "critical", "", "系统解释器替换（后门安装）", "使用 update-alternatives 替换系统解释器——持久化后门安装。",
     r"\bupdate-alternatives\s+.*--install\s+(?:\/usr)?\/(?:bin|local\/bin)\/(?:python|python3|node|ruby|php|perl|java|bash|sh)\b", "i"),
    ("exec.openssl_s_client", "high", "", "openssl 反弹 shell", "通过 openssl s_client 建立加密网络连接——可用于反弹 shell。",
     r"\bopenssl\s+s_client\s+.*-connect\s", "i"),
    ("exec.difftool_ssh", "critical", "", "通过 diff/工具读取 SSH 密钥", "通过 diff 类工具读取 SSH 密钥——绕过常规文件读取检测。",
     r"\b(diff|comm|join|paste|cut)\s+.*~?\/?\.ssh\/(id_rsa|id_ed25519|id_ecdsa|authorized_keys)", "i"),
    ("exec.difftool_aws", "critical", "", "通过 diff/工具读取 AWS 凭证", "通过 diff 类工具读取 AWS 凭证。",
     r"\b(diff|comm|join|paste|cut)\s+.*~?\/?\.aws\/(credentials|config)", "i"),
    ("exec.deno_run", "high", "", "Deno 运行时代码执行", "通过 Deno 运行时执行代码——可访问文件系统和网络。",
     r"\bdeno\s+.*?(?:eval|run)\s", "i"),
    ("exec.bun_run", "high", "", "Bun 运行时代码执行", "通过 Bun 运行时执行代码——可访问文件系统和网络。",
     r"\bbun\s+.*?(?:-e|eval|run)\s", "i"),
    ("exec.lua_inline_exec", "critical", "", "Lua 内联系统命令执行", "通过 Lua -e 执行系统命令——常见于 nginx/OpenResty 环境。",
     r"\blua\s+.*?-e\s+.*\b(os\.execute|io\.popen|os\.remove)\b", "i"),
    ("exec.at_schedule", "high", "", "at 定时执行", "通过 at 命令定时执行任务——可能建立延迟后门。",
     r"\bat\s+(now|midnight|noon|teatime|\d{1,2}:\d{2})\b", "i"),
    ("exec.screen_tmux_detached", "high", "", "后台分离执行", "通过 screen/tmux 后台执行命令——隐藏恶意进程。",
     r"\b(screen|tmux)\s+.*(-[dD]|new-session\s+-d)\s", "i"),
    ("exec.rev_pipe_shell", "critical", "", "字符串反转执行", "通过 rev 反转命令字符串并执行——绕过命令模式检测。",
     r"\brev\b.*\|\s*(sh|bash|zsh|dash)\b", "i"),
    ("exec.xxd_pipe_shell", "critical", "", "十六进制解码执行", "通过 xxd 解码十六进制载荷并执行——绕过 base64 检测。",
     r"\bxxd\s+.*-r\b.*\|\s*(sh|bash|zsh)\b", "i"),
    ("exec.ps_encoded_command", "critical", "", "PowerShell 编码命令", "运行编码的 PowerShell 命令——Windows 上标准的恶意软件混淆技术。",
     r"powershell\s.*-enc(odedcommand)?\s", "i"),
    ("exec.ps_iwr_iex", "critical", "", "PowerShell 远程代码执行", "通过 PowerShell 下载并执行代码。",
     r"Invoke-WebRequest.*\|\s*(iex|Invoke-Expression)", "i"),
    ("exec.ps_webclient", "critical", "", "PowerShell WebClient 下载", "通过 PowerShell .NET WebClient 下载文件——常见恶意载荷投递方式。",
     r"\(New-Object\s+Net\.WebClient\)\.Download", "i"),
    ("exec.ps_bits", "high", "", "PowerShell BITS 传输", "通过 BITS 服务下载文件——可绕过应用层防火墙。",
     r"Start-BitsTransfer\b", "i"),
    ("exec.certutil", "critical", "", "Windows certutil 下载/编码", "通过 certutil 下载文件或编码数据——Windows 常见 LOLBin 手法。",
     r"\bcertutil\b.*(-urlcache|-encode|-decode)", "i"),
    ("exec.mshta", "critical", "", "Windows mshta 远程执行", "通过 mshta 执行远程 HTA 文件——Windows LOLBin 代码执行。",
     r"\bmshta\s+https?:", "i"),
    ("exec.regsvr32", "critical", "", "Windows regsvr32 远程加载", "通过 regsvr32 加载远程 scriptlet——Windows LOLBin 代码执行。",
     r"\bregsvr32\s+.*\/i:", "i"),
    ("exec.msiexec_remote", "critical", "", "Windows msiexec 远程安装", "通过 msiexec 远程安装恶意 MSI 包。",
     r"\bmsiexec\s+.*\/i\s+https?:", "i"),
    ("exec.wmic_create", "critical", "", "Windows wmic 进程创建", "通过 wmic process call create 执行命令——Windows LOLBin 代码执行。",
     r"\bwmic\s+(?:process|os)\s+.*\bcall\s+create\b", "i"),
    ("exec.bitsadmin", "high", "", "Windows bitsadmin 文件传输", "通过 bitsadmin BITS 服务下载文件——可绕过安全监控。",
     r"\bbitsadmin\s+.*\/(?:transfer|create)\b", "i"),
    ("exec.devshm_drop_exec", "critical", "", "通过 /dev/shm 内存执行恶意载荷", "将文件写入 /dev/shm 并赋予执行权限——无文件恶意软件部署技术。",
     r"\b(?:cp|wget|curl|dd)\s+.*\/dev\/shm\/.*&&.*chmod\s+\+x", "i"),
    ("exec.devshm_run", "critical", "", "从 /dev/shm 执行脚本", "直接从 /dev/shm 内存文件系统执行脚本——无文件攻击向量。",
     r"\b(?:bash|sh|\.\/)\s*\/dev\/shm\/\S+", "i"),
    ("exec.proc_mem_dump", "critical", "", "进程内存凭证提取", "读取 /proc/[pid]/mem 提取进程内存中的凭证——CI/CD runner 攻击向量。",
     r"\b(?:dd|strings|cat|head)\s+.*\/proc\/\d+\/mem\b", "i"),
    ("exec.cgroup_release_agent", "critical", "", "容器逃逸：cgroup release_agent", "通过 cgroup release_agent 或 notify_on_release 在宿主机执行命令。",
     r"\/sys\/fs\/cgroup\/.*(?:release_agent|notify_on_release)", "i"),
    ("exec.docker_exec_shell", "high", "", "Docker exec shell 访问", "通过 docker exec 在容器中获取 shell——容器横向移动。",
     r"\bdocker\s+exec\s+.*\b(sh|bash|zsh|ash)\b", "i"),
    ("exec.kubectl_exec_shell", "high", "", "Kubectl exec shell 访问", "通过 kubectl exec 在 Pod 中获取 shell——Kubernetes 横向移动。",
     r"\bkubectl\s+exec\s+.*?(?:--\s*)?(?:\/\w+\/)*\b(sh|bash|zsh|ash)\b", "i"),
    ("exec.docker_cp", "high", "", "Docker cp 文件提取", "通过 docker cp 从容器提取文件——可用于数据外泄。",
     r"\bdocker\s+cp\s+(?:-\S+\s+)*\S+:", "i"),
    ("exec.kubectl_cp", "high", "", "Kubectl cp 文件提取", "通过 kubectl cp 从 Pod 提取文件——可用于数据外泄。",
     r"\bkubectl\s+cp\s+(?:-\S+\s+\S+\s+)*\S+:", "i"),
    ("exec.docker_socket", "critical", "", "Docker socket 直接交互", "通过 Unix socket 直接操作 Docker daemon——可逃逸容器或提权。",
     r"--unix-socket\s+.*docker\.sock", "i"),
    ("exec.ps_env_enum", "high", "", "进程环境变量枚举", "通过 ps auxeww 导出所有进程环境变量——可泄露 API 密钥和凭证。",
     r"\bps\s+.*auxe", "i"),
    ("exec.llm_base_url_hijack", "critical", "", "LLM API 基地址劫持", "修改 LLM 服务基地址——可将 API 请求和密钥重定向到攻击者服务器。",
     r"(?:ANTHROPIC|OPENAI|GEMINI|AZURE_OPENAI|MISTRAL|COHERE)_(?:BASE_URL|API_BASE|API_ENDPOINT)\s*=", "i"),
    ("exec.clipboard_pipe", "high", "", "剪贴板数据外泄", "通过管道将数据发送到剪贴板工具——可窃取敏感输出。",
     r"\|.*\b(pbcopy|xclip|xsel)\b", "i"),
    ("exec.tmux_capture", "high", "", "终端会话捕获：tmux", "通过 tmux capture-pane 捕获终端会话内容——可窃取敏感输出。",
     r"\btmux\s+capture-pane\b", "i"),
    ("exec.screen_hardcopy", "high", "", "终端会话捕获：screen", "通过 screen hardcopy 捕获终端会话内容——可窃取敏感输出。",
     r"\bscreen\s+-X\s+hardcopy\b", "i"),
    ("exec.script_record", "high", "", "终端会话录制", "通过 script 命令录制终端会话——可捕获所有输入输出包括密码。",
     r"(?:^|[;&|]\s*)\bscript\s+(?:-[a-zA-Z]\s+)*\/?\S+", "i"),
    ("exec.eval_heredoc", "high", "", "eval heredoc 注入", "eval 配合 heredoc (<<) 注入多行命令——可隐藏恶意载荷。",
     r"""\beval\s*<<\s*['"]?\w*""", "i"),
    ("exec.npm_registry", "high", "", "npm 自定义 registry 安装", "使用自定义 registry 安装 npm 包——可能从恶意源安装后门包。",
     r"\bnpm\s+(?:install|i|add|ci)\s+.*--registry\s+https?:\/\/", "i"),
    ("exec.pip_index", "high", "", "pip 自定义 index 安装", "使用自定义 PyPI index 安装 pip 包——可能从恶意源安装后门包。",
     r"\bpip3?\s+install\s+.*(?:--index-url|-i)\s+https?:\/\/", "i"),
    ("exec.pip_extra_index", "high", "", "pip 额外 index 注入", "通过 --extra-index-url 添加额外 PyPI index——依赖混淆攻击的常见手法。",
     r"\bpip3?\s+install\s+.*--extra-index-url\s+https?:\/\/", "i"),
    ("exec.npmrc_write", "high", "", ".npmrc registry 配置篡改", "向 .npmrc 写入或追加内容——可能设置恶意 registry 或注入 auth token。",
     r">{1,2}\s*~?\/?(?:[\w./-]*\/)?\.npmrc\b", "i"),
    ("exec.cargo_registry", "high", "", "cargo 自定义 registry 安装", "使用自定义 registry/index 安装 cargo 包——可能从恶意源安装后门 crate。",
     r"\bcargo\s+install\s+.*--(?:registry|index)\s+https?:\/\/", "i"),
)
