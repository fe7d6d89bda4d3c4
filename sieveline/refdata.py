"""Names, patterns and word lists that results depend on.

They are plain constants in natural order. Larger inputs (hash lists, own domain lists) come as DataFrames.
"""

from __future__ import annotations

INFO, REVIEW, WARNING = "INFO", "REVIEW", "WARNING"
LOW, MEDIUM, HIGH = "LOW", "MEDIUM", "HIGH"
SEVERITIES = {INFO: 0, REVIEW: 1, WARNING: 2}
CONFIDENCES = {LOW: 0, MEDIUM: 1, HIGH: 2}

# API names of compiled classes and the group that each belongs to.
API_PACKAGE_PREFIXES = {
    "java/lang/instrument/": "instrumentation",
    "javax/naming/directory/": "jndi",
    "com/sun/jna/": "native_loading",
    "java/net/http/": "network",
    "okhttp3/": "network",
    "org/apache/http/": "network",
    "java/lang/reflect/": "reflection",
}
API_CLASSES = {
    "java/awt/datatransfer/Clipboard": "clipboard",
    "javax/crypto/Cipher": "crypto",
    "java/net/URLClassLoader": "dynamic_loading",
    "java/security/SecureClassLoader": "dynamic_loading",
    "javax/naming/InitialContext": "jndi",
    "java/net/DatagramSocket": "network",
    "java/net/HttpURLConnection": "network",
    "java/net/ServerSocket": "network",
    "java/net/Socket": "network",
    "java/net/URLConnection": "network",
    "javax/net/ssl/HttpsURLConnection": "network",
    "java/lang/ProcessBuilder": "process_execution",
    "jdk/internal/misc/Unsafe": "unsafe",
    "sun/misc/Unsafe": "unsafe",
}
#: owner#member; an owner of * stands for any.
API_MEMBERS = {
    "java/util/Base64#getDecoder": "base64",
    "java/util/Base64#getMimeDecoder": "base64",
    "java/awt/Toolkit#getSystemClipboard": "clipboard",
    "*#defineAnonymousClass": "dynamic_loading",
    "*#defineClass": "dynamic_loading",
    "*#defineHiddenClass": "dynamic_loading",
    "java/lang/Runtime#load": "native_loading",
    "java/lang/Runtime#loadLibrary": "native_loading",
    "java/lang/System#load": "native_loading",
    "java/lang/System#loadLibrary": "native_loading",
    "java/net/URL#openConnection": "network",
    "java/net/URL#openStream": "network",
    "java/lang/Runtime#exec": "process_execution",
    "java/lang/Class#forName": "reflection",
    "java/lang/Class#getDeclaredField": "reflection",
    "java/lang/Class#getDeclaredMethod": "reflection",
    "java/lang/Class#getMethod": "reflection",
    "java/awt/Robot#createScreenCapture": "screen_capture",
}
CLASSLOADER_SUPERCLASSES = ["java/lang/ClassLoader", "java/net/URLClassLoader", "java/security/SecureClassLoader"]
FILE_WRITE_CLASSES = ["java/io/FileOutputStream", "java/io/FileWriter", "java/io/RandomAccessFile"]
FILE_WRITE_MEMBERS = [
    "java/net/http/HttpResponse$BodyHandlers#ofFile",
    "java/nio/file/Files#copy",
    "java/nio/file/Files#newBufferedWriter",
    "java/nio/file/Files#newOutputStream",
    "java/nio/file/Files#write",
    "java/nio/file/Files#writeString",
]
NATIVE_FILE_LOAD_MEMBERS = [
    "com/sun/jna/Native#load",
    "com/sun/jna/Native#loadLibrary",
    "com/sun/jna/Native#register",
    "com/sun/jna/NativeLibrary#getInstance",
    "java/lang/Runtime#load",
    "java/lang/Runtime#loadLibrary",
    "java/lang/System#load",
    "java/lang/System#loadLibrary",
]
REFLECTION_TARGETS = [
    "java.lang.ClassLoader",
    "java.lang.ProcessBuilder",
    "java.lang.Runtime",
    "java.lang.instrument.Instrumentation",
    "java.net.URLClassLoader",
    "javax.naming.InitialContext",
    "sun.misc.Unsafe",
]
EXTERNAL_SOURCE_TAGS = ["base64", "crypto", "encoded_payload", "encoded_url", "network"]
EXECUTION_TAGS = ["dynamic_loading", "native_file_load", "process_execution"]
SESSION_TOKEN_MEMBERS = ["func_111286_b", "func_148254_d", "getAccessToken", "getSessionId", "method_1674"]
SESSION_TOKEN_OWNERS = ["net/minecraft/", "com/mojang/"]
BYTECODE_LIBRARY = r"(^|/)(objectweb/asm/ClassWriter|bytebuddy/)"
DESCRIPTOR = r"\((\[*([BCDFIJSZ]|L[\w/$\x01]+;))*\)\[*([BCDFIJSZV]|L[\w/$\x01]+;)"

# Project names that others imitate.
POPULAR_NAMES = """
ae2 alexsmobs appleskin appliedenergistics2 architectury balm betterf3 biomesoplenty botania c2me citadel citizens cloth
clothconfig continuity controlling coreprotect create creativecore curios discordsrv dynamicfps embeddium emi entityculling
essential essentials essentialsx fabric fabricapi fabriclanguagekotlin farmersdelight ferritecore floodgate ftblibrary
ftbquests geckolib geyser griefprevention immediatelyfast indium inventoryprofilesnext iris ironchests jade jei journeymap
kotlinforforge krypton kubejs lambdynlights lazydfu litematica lithium luckperms malilib mekanism memoryleakfix minihud
modernfix modmenu moonlight mousetweaks multiversecore oculus optifabric optifine patchouli phosphor placeholderapi
protocollib puzzleslib quark reesessodiumoptions replaymod roughlyenoughitems rubidium skript sodium sodiumextra
sophisticatedbackpacks starlight storagedrawers supplementaries tconstruct terralith travelersbackpack trinkets tweakeroo
twilightforest vault viabackwards viaversion voicechat waystones worldedit worldguard wthit xaerominimap xaeroworldmap
yetanotherconfiglib zoomify
""".split()

# Domains by what they are known for.
KNOWN_DOMAINS = """
apache.org bitbucket.org bstats.org bukkit.org creativecommons.org crowdin.com curse.com curseforge.com discord.com discord.gg
discordapp.com fabricmc.net forgecdn.net github.com github.io githubusercontent.com gitlab.com gnu.org google.com java.com
jetbrains.com json-schema.org ko-fi.com kotlinlang.org live.com logback.qos.ch maven.org microsoft.com minecraft.net
minecraft.wiki minecraftforge.net minecraftservices.com modrinth.com mojang.com mozilla.org neoforged.net openjdk.org
opensource.org oracle.com papermc.io patreon.com paypal.com paypal.me quiltmc.org reddit.com schema.org slf4j.org sonatype.org
spigotmc.org spongepowered.org sun.com twitch.tv twitter.com w3.org wikipedia.org x.com xboxlive.com xml.org youtu.be youtube.com
""".split()
PASTE_DOMAINS = "controlc.com ghostbin.com hastebin.com paste.ee paste.gg pastebin.com pastes.dev privatebin.net rentry.co rentry.org".split()
TUNNEL_DOMAINS = "ddns.net duckdns.org hopto.org loca.lt ngrok-free.app ngrok.app ngrok.io no-ip.com no-ip.org portmap.host portmap.io serveo.net trycloudflare.com".split()
FILE_HOST_DOMAINS = "anonfiles.com catbox.moe file.io filebin.net gofile.io litter.catbox.moe mediafire.com mega.nz sendspace.com transfer.sh".split()
SHORTENER_DOMAINS = "bit.ly cutt.ly goo.gl is.gd rb.gy shorturl.at t.ly tinyurl.com".split()
IP_LOOKUP_DOMAINS = "checkip.amazonaws.com icanhazip.com ifconfig.me ip-api.com ipify.org ipinfo.io myexternalip.com wtfismyip.com".split()
FREE_TLDS = "cf ga gq ml tk".split()
EXFIL_FRAGMENTS = {"api.telegram.org/bot": "Telegram bot API"}
WEBHOOK = r"discord(app)?\.com/api/(v[0-9]+/)?webhooks"
WEBHOOK_WHOLE = WEBHOOK + r"/[0-9]+/[0-9A-Za-z_-]+"
URL = r"(?i)\b(?:https?|ftp|wss?)://[^\s\"'<>\\^`{|}]{1,500}"
IP_PORT = r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}):[0-9]{2,5}\b"
#: Ranges of IPv4 addresses that are not public: first and last.
PRIVATE_IPV4 = [
    ("0.0.0.0", "0.255.255.255"),
    ("10.0.0.0", "10.255.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.8"),
    ("192.0.0.11", "192.0.0.255"),
    ("192.0.2.0", "192.0.2.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"),
    ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"),
    ("240.0.0.0", "255.255.255.255"),
]

# Fragments of text by the category that they point to.
SENSITIVE = {
    "Antivirus tampering": ["add-mppreference", "exclusionpath", "set-mppreference"],
    "Browser credential/cookie storage": ["/google/chrome/user data", r"\google\chrome\user data", "bravesoftware", "encrypted_key", "key4.db", "login data", "logins.json", r"mozilla\firefox\profiles", "opera software"],
    "Command shell": ["/bin/bash", "/bin/sh", "cmd.exe", "powershell"],
    "Cryptocurrency mining": ["stratum+tcp://", "xmrig"],
    "Cryptocurrency wallet": [r"electrum\wallets", "exodus.wallet", "nkbihfbeogaeaoehlefnkodbefgpgknn", "wallet.dat"],
    "Discord token storage": ["discordcanary", "discordptb", "dqw4w9wgxcq:", "local storage/leveldb", r"local storage\leveldb"],
    "Minecraft launcher account files": [
        "feather/accounts.json", "launcher_accounts.json", "launcher_accounts_microsoft_store.json", "microsoft_accounts.json", "multimc/accounts.json", "polymc/accounts.json",
        "prismlauncher/accounts.json", r"prismlauncher\accounts.json", "settings/game/accounts.json", r"settings\game\accounts.json", "tlauncheradditional.json",
    ],
    "Startup persistence": [r"\start menu\programs\startup", r"currentversion\run", "launchagents", "schtasks"],
    "Windows credential decryption": ["cryptunprotectdata"],
}
SHELL_CATEGORY, PERSISTENCE_CATEGORY = "Command shell", "Startup persistence"
HIGH_RISK_CATEGORIES = [c for c in SENSITIVE if c not in (SHELL_CATEGORY, PERSISTENCE_CATEGORY)]
SHELL_COMMANDS = "/bin/bash /bin/sh /bin/zsh /usr/bin/env bash cmd cmd.exe cscript cscript.exe mshta mshta.exe osascript powershell powershell.exe pwsh pwsh.exe sh wscript wscript.exe zsh".split()
RISKY_COMMANDS = "attrib bitsadmin bitsadmin.exe certutil certutil.exe chmod curl curl.exe java java.exe javaw javaw.exe regsvr32 regsvr32.exe rundll32 rundll32.exe schtasks schtasks.exe wget".split()
HELPER_COMMANDS = "ldd lspci xdg-open open explorer explorer.exe wmic nvidia-smi system_profiler sysctl uname sw_vers".split()
HIDDEN_FLAGS = ["-ep bypass", "-executionpolicy bypass", "-w hidden", "-windowstyle hidden", "nohup ", "-enc ", "-encodedcommand", "//b", 'createobject("wscript.shell")']
PROGRAM_EXTENSIONS = ".bat .class .cmd .dll .dylib .exe .jar .msi .ps1 .scr .sh .so .vbs".split()
MALWARE_WORDS = "backdoor clipper cryptominer exfil grabber keylog ratclient stealer tokengrab tokenlog webhook".split()
CHEAT_WORDS = "aimbot anchoraura antiknockback autoclicker autocrystal autototem bedaura boatfly crystalaura elytrafly fastbreak killaura nofall noslow nuker speedmine triggerbot xray".split()
RESERVED_PACKAGES = ["com/mojang/", "java/", "jdk/", "net/minecraft/", "sun/"]
KNOWN_CLIENTS = {
    "Baritone (automation/pathfinding bot)": "baritone/",
    "KAMI": "me/zeroeightsix/kami/",
    "LiquidBounce": "net/ccbluex/liquidbounce/",
    "Meteor Client": "meteordevelopment/meteorclient/",
    "RusherHack": "org/rusherhack/",
    "Wurst Client": "net/wurstclient/",
}

# Inventory of archive entries.
NATIVE_EXTENSIONS = ".dll .dylib .jnilib .so".split()
EXECUTABLE_EXTENSIONS = ".app .bat .cmd .com .command .exe .hta .jse .lnk .msi .ps1 .psm1 .scr .sh .vbe .vbs .wsf".split()
COMMON_EXTENSIONS = """
.accesswidener .aw .bbmodel .bin .cfg .class .classtweaker .conf .css .dat .dsa .ec .frag .fsh .geo .gif .glsl .gz .html .idx .jar
.jpeg .jpg .json .json5 .kotlin_builtins .kotlin_module .lang .list .mappings .mcfunction .mcmeta .md .mf .mtl .nbt .obj .ogg .otf
.png .properties .rsa .sf .snbt .srg .tiny .toml .ttf .txt .vert .vsh .wav .webp .xml .yaml .yml .zip
""".split()
BARE_NAMES = "license licence notice readme copying changelog authors credits contributors".split()
#: Magic bytes (hex) in order of tests, with what they say.
MAGIC = {
    "504B0304": "ZIP/JAR archive",
    "504B0506": "ZIP/JAR archive (empty)",
    "4D5A": "Windows executable (PE)",
    "7F454C46": "Linux executable (ELF)",
    "CAFEBABE": "Java class file (or Mach-O universal binary)",
    "CFFAEDFE": "macOS executable (Mach-O)",
    "CEFAEDFE": "macOS executable (Mach-O)",
    "52617221": "RAR archive",
    "377ABCAF": "7-Zip archive",
    "1F8B": "GZIP archive",
}
#: Extensions that a magic may have; other magics are never disguised.
MAGIC_EXTENSIONS = {
    "Windows executable (PE)": ".com .dll .exe .scr .sys".split(),
    "Linux executable (ELF)": [".so"],
    "Java class file (or Mach-O universal binary)": ".class .dylib .jnilib".split(),
    "macOS executable (Mach-O)": ".dylib .jnilib".split(),
    "ZIP/JAR archive": ".jar .litemod .mcpack .zip".split(),
}
AGENT_ATTRIBUTES = ["Premain-Class", "Agent-Class", "Launcher-Agent-Class"]
#: Descriptor files in the order in which they are read, with the loader of each.
DESCRIPTORS = {
    "fabric.mod.json": "Fabric",
    "quilt.mod.json": "Quilt",
    "META-INF/mods.toml": "Forge",
    "META-INF/neoforge.mods.toml": "NeoForge",
    "mcmod.info": "Forge (legacy)",
    "plugin.yml": "Bukkit",
    "paper-plugin.yml": "Paper",
}
