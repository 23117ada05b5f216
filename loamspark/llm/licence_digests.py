"""Digests of whole licences in the bare form of op1_licences (bare_digest of the file named), by their SPDX names without -only and -or-later.

Debian: /usr/share/common-licenses; rust-docs: licenses of the Rust toolchain's documents. If a step of the bare form changes, take them anew.
"""

BARE: dict[str, str] = {
    "3b389a1b7ffd403effc5ebf0108be51637dc28d6afce5f0e9bf80d8a19b31f12": "Apache-2.0",  # Debian Apache-2.0
    "4ac97b7e65089f518f29e58fdbb593919c97734f80a6725418858d3ee917d6b0": "GPL-1.0",  # Debian GPL-1
    "9e6ae63dc4fe91c26512dbe052942422a8aa10ad82d67b1c4ace14f13eefda52": "GPL-2.0",  # Debian GPL-2
    "ba5d3a2d54a520238c6810cbea80ca489c2f5d2823966fbc2f825338638db7ff": "GPL-2.0",  # rust-docs GPL-2.0-only.txt
    "851f6c575591ede08895e0b2e7ab5564698e2ceec3b0499461baccf40da292d8": "GPL-3.0",  # Debian GPL-3
    "23127f2ec5bff9cf5b34795422d27864b8bb8f50c9ba90e6d09c282a5e9bd624": "GPL-3.0",  # rust-docs GPL-3.0-or-later.txt
    "0d450f706803d68dc47de993bbf985188b4a6ce24e450c4a6815b25a0838b60e": "LGPL-2.0",  # Debian LGPL-2
    "db0967aba42e66b4d209c87fb4378e41d54009d72db6677fb869574a1e9011ca": "LGPL-2.1",  # Debian LGPL-2.1
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",  # Debian LGPL-3
    "7c9cc2c2e8e690b874dd530cf58dbe70befdc1385d037c4fa17384d4ee5dfd32": "AGPL-3.0",  # the reference's LICENSE
    "39eeadeeae2028f6a2fe2942480c22d2b3f8ac1471a202d3e8590e42e3e9e3f9": "MPL-1.1",  # Debian MPL-1.1
    "69f6493c4913eb24589871629256ea61c70ccba4e85aa0a166974a6128138db6": "MPL-2.0",  # Debian MPL-2.0
    "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e": "CC0-1.0",  # Debian CC0-1.0
    "6fd32d7fe30fa66c101714769c97e3e375bdf90cc19532508e2dfb4d98a92a9d": "CC-BY-SA-4.0",  # rust-docs CC-BY-SA-4.0.txt
    "7d22b7f71c19a201744c15e35964b96c5947e2820f2cf03ae8452ee879c218f3": "GFDL-1.2",  # Debian GFDL-1.2
    "feb1941cea70054d10ac5041fa294cbceaaac7b4f19a85a4f70d3dcdbc6d6f65": "GFDL-1.3",  # Debian GFDL-1.3
    "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702": "Artistic-1.0",  # Debian Artistic
    "bede4aa57fdf1d7c676c2f22fa0839432b3d423dc298ef754f1720b9cb9fc6a6": "BSD-3-Clause",  # Debian BSD
    "788cc8843bf483eb3ea3b5f6c317b95502da6e7105963f7c57c872ceb263fd49": "Unlicense",  # aho-corasick UNLICENSE
    "92044b985f5e58898c069d6973a0abb208a7f520faf3df3c3f878d3618fb48ac": "BSL-1.0",  # xxhash-rust LICENSE
    "f29bf6ad3ea8f2044221e3c35d604a8313bae039d8ec71ae45d56ef79984e7be": "NCSA",  # rust-docs NCSA.txt
    "a4915a2dcd67c648b73ad8364858cba28bbfb700e62ca5847e2c30544066e01a": "OFL-1.1",  # rust-docs OFL-1.1.txt
    "53113a39b79251016cf92b8348f303cee44e4faee1f232536754abc669dd32c8": "Unicode-3.0",  # rust-docs Unicode-3.0.txt
    "6282a4545628e243ce0a8f4ab5ce4ed91ad0181c8c1402e1734a0dcdacc69aa9": "ISC",  # rust-docs ISC.txt
    "e61da4b5a0b72bac48126a63d2cc67a082c0512730a34696382eaa3a6ab07185": "Apache-2.0",  # Debian Apache-2.0, without what follows its terms
    "a5ff9aad3ebba530eafd58a0eaa974ec1e272d9042fe216b4fe3bd4ce8605462": "Apache-2.0",  # Debian Apache-2.0, terms alone
    "3fd32e07990a51bbdebe0dde1446ae639446153dda8b041b2af3b0f493515920": "GPL-1.0",  # Debian GPL-1, without what follows its terms
    "7df3b2a784663f465cdd83fb3e6703555da5b169756028fb7985db382877efb7": "GPL-1.0",  # Debian GPL-1, terms alone
    "748e7faa070c8b147fcdccd10eff3014465f5b004d6b7f4a3b9daec69f980903": "GPL-2.0",  # Debian GPL-2, without what follows its terms
    "4440336c1bacafb9a94d99078947c988951ac62cbce19b0afdc4c515fbe3f32a": "GPL-2.0",  # Debian GPL-2, terms alone
    "eeef63e795cc04178a5032496be4c0b5be69d00c23e20dd4b2f3307162c071ad": "GPL-2.0",  # rust-docs GPL-2.0-only.txt, without what follows its terms
    "0499aff2e894eec6141727c6e1c5b0059d73618c6ff8fa67b816cec8c418d5c3": "GPL-2.0",  # rust-docs GPL-2.0-only.txt, terms alone
    "22fb9eab6c587ba29bf311c60aba8ee70bbd3dc03ec5eecdfb7f3b4188c969cd": "GPL-3.0",  # Debian GPL-3, without what follows its terms
    "f5faf9b905f587deca8a69ec8502726a00807a41ff4a410e1f8ecd7b6cc3e134": "GPL-3.0",  # Debian GPL-3, terms alone
    "27f3ee715b35c9d7aa22bdc8f97a48d9e7c0df3d37fca4f663d5e47561e38374": "LGPL-2.0",  # Debian LGPL-2, without what follows its terms
    "665963410c58cfb86ebe9847e3dbb5bfaea0d0e84c58b86cddc04d27e9ddac7c": "LGPL-2.0",  # Debian LGPL-2, terms alone
    "6f53003727a741ba6c0db38bf915d1221d9a1c0990d3c5383328d98241fcdcec": "LGPL-2.1",  # Debian LGPL-2.1, without what follows its terms
    "c1d7ce9c22e496317555e57c1e40269e18dd64b86807db063728ee9b5f39ab6d": "LGPL-2.1",  # Debian LGPL-2.1, terms alone
    "2299534f97fea828375c1439d345166789a1d8441aea4185881b9df420138165": "AGPL-3.0",  # the reference's LICENSE, without what follows its terms
    "0cd6e781efe54508c09a26db2e8ca30969ea6218950dadab6256d2338744b22c": "AGPL-3.0",  # the reference's LICENSE, terms alone
    "8403a35ce9fc298cc5cfdf4409fcc23cdd773c206bcb9ed6e71a26a589c9eb7c": "BSD-3-Clause",  # BSD-2-Clause with its third clause
}
