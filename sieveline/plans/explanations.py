"""What each rule looks at and why a reader may care, and what a rating says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXPLANATIONS = {
    "hash.suspicious": "The file's SHA-256 is on the given list as suspicious.",
    "hash.verified": "The file's SHA-256 is on the given list as verified.",
    "metadata.none": "No known descriptor was found; libraries and older projects often have none.",
    "metadata.detected": "Descriptors that say what the project is and which loader reads it.",
    "metadata.incomplete": "A descriptor leaves out its id or version, so the file cannot be told apart by them.",
    "metadata.inconsistent_id": "Descriptors of one file name different ids; builds for several loaders normally share one.",
    "metadata.inconsistent_version": "Descriptors of one file name different versions.",
    "metadata.missing_entrypoint": "A class that a descriptor starts is not in the file; it may come from a library, or the file was repacked.",
    "metadata.popular_mod_claim": "The file names itself as a popular project; only the publisher's checksum can confirm that.",
    "metadata.lookalike": "The name differs from a popular project's by signs that look alike or by a letter or two.",
    "manifest.main_class": "The file can be started on its own, outside the game.",
    "manifest.java_agent": "An agent may rewrite any class of the program that it joins.",
    "manifest.coremod": "A core plug-in runs early and may rewrite the game's classes.",
    "contents.executables": "Programs and scripts run outside Java's checks.",
    "contents.native_libraries": "Native libraries are common for sound, windows or compression; they cannot be read here.",
    "contents.disguised": "The first bytes say that this is a program, the extension says otherwise.",
    "contents.hidden_archive": "The first bytes say that this is an archive, the extension says otherwise.",
    "contents.encrypted": "Encrypted entries cannot be looked into.",
    "contents.duplicates": "Readers disagree on which of two entries of a name counts.",
    "contents.unsafe_paths": "Such a name can write outside the folder that an archive is unpacked to.",
    "contents.deceptive_names": "Hidden or reversing signs make a name look like another.",
    "contents.compression_ratio": "Entries that inflate very far can exhaust memory or disk.",
    "contents.large_files": "Large entries are told for completeness.",
    "contents.nested_jars": "Archives inside are read as well, to a bounded depth.",
    "contents.unusual_files": "Kinds of files that such archives seldom hold.",
    "contents.signed": "Signature files are present; the signature itself is not verified here.",
    "classes.invalid": "Classes that do not follow the format may be damaged or made to stop tools.",
    "classes.incomplete": "A limit of reading was met, so these classes were not looked at.",
    "classes.name_mismatch": "A class calls itself otherwise than its path does.",
    "classes.confusable_names": "Names made of signs that look alike hinder reading.",
    "classes.non_ascii_names": "Other letters in class names can imitate known names.",
    "classes.default_package": "Classes outside any package are unusual in published projects.",
    "classes.reserved_namespace": "These packages belong to Java itself.",
    "classes.cheat_feature_names": "Names of features that many servers forbid.",
    "classes.cheat_feature_strings": "Texts name features that many servers forbid.",
    "classes.known_client": "Packages of a known utility client.",
    "classes.malware_names": "Words that malware uses for its parts; harmless projects use some of them too.",
    "classes.obfuscated": "Renamed classes hide what the code does; some publishers do so for protection.",
    "classes.partly_obfuscated": "Part of the classes is renamed, often a bundled library.",
    "api.reflection": "Reflection calls code by name; nearly every larger project uses it.",
    "api.network": "Network access is usual for updates and multiplayer features.",
    "api.instrumentation": "Instrumentation rewrites classes while a program runs.",
    "api.jndi": "Directory lookups can load code from elsewhere.",
    "api.screen_capture": "Pictures of the screen can be taken.",
    "api.clipboard": "The clipboard can be read or written; it may hold passwords.",
    "api.crypto": "Ciphers protect data as well as hide it.",
    "api.unsafe": "Raw memory access is used for speed by many libraries.",
    "api.session_token": "The token lets its holder act as the player.",
    "api.process_execution": "Other programs can be started with the player's rights.",
    "api.downloads": "Data from the network can be written to disk.",
    "api.reflective_sensitive": "A class that can run or load code is named in a text, as reflection would use it.",
    "api.native_loading": "Native code runs outside Java's checks; where the library comes from matters.",
    "api.dynamic_loading": "Classes can be loaded that are not in the file; where they come from matters.",
    "combo.downloader": "One class reaches the network and can run code, as a downloader would.",
    "combo.downloader_spread": "The file reaches the network and can run code, though not in one class.",
    "combo.hidden_execution": "A program is started with flags that keep it out of sight.",
    "combo.persistence_exec": "Programs are started next to places that make them start again after a reboot.",
    "combo.decoded_exec": "Data is decoded or decrypted next to code that can run it.",
    "combo.session_token_network": "The session token is read where the network is reached.",
    "combo.data_theft": "Places of private data are named in a file that can send them away.",
    "combo.packed_payload": "A program is kept as text in a file that can decode or load it.",
    "strings.url": "An address of a kind that is also used to receive stolen data or to hand out programs.",
    "strings.urls_other": "Addresses that match no list, told for completeness.",
    "strings.ip_port": "A public address with a port, without a name that could be looked up.",
    "strings.sensitive": "A text names a place or a tool that private data or commands hang on.",
    "strings.encoded": "Long texts that look encoded; pictures and keys look so too.",
    "strings.encoded_executable": "A text decodes to the first bytes of a program or archive.",
    "strings.encoded_url": "An address is only visible after decoding.",
    "batch.duplicate_mod_id": "Several files declare this id; a loader takes one of them only.",
}

RATIONALES = {
    "INFO/LOW": "Told for context; common in harmless files.",
    "REVIEW/LOW": "Worth a look; harmless files often show it.",
    "REVIEW/MEDIUM": "Worth a look; further signs stand beside it, or harmless files seldom show it.",
    "REVIEW/HIGH": "Worth a look; the sign itself is certain, its purpose is not.",
    "WARNING/LOW": "Would be serious, but this sign alone is weak.",
    "WARNING/MEDIUM": "Serious together with the other signs in the file; a harmless reason is possible.",
    "WARNING/HIGH": "Serious, and the signs meet in one place or are certain by themselves.",
}


def explanation_of(rule: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in EXPLANATIONS.items() for x in pair])[rule]
